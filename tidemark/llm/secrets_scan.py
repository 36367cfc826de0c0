"""Secret scan: fixed patterns, and a character convolutional network over every candidate with its context.

The network learns from findings that a fixed recipe makes (keys of many formats with the words that surround them, and look-alikes:
dates, versions, paths, prices, identifiers, long words), as no labelled ones exist; its recall is measured on others of the same recipe.

Candidates are all runs of 16 or more key characters that a match of the fixed patterns doesn't cover whole, and these matches. Each is
read by a small convolutional network (numpy) with CONTEXT characters on either side; a candidate longer than INSIDE in
windows of that length all over it, of which the highest score counts. On findings held out of training, scores are calibrated by
Platt's method and the threshold is the highest that keeps the recall sought. Candidates at or above the threshold are findings of kind `model`; matches of the
fixed patterns are findings whatever their score.

Null and empty texts have no findings. Texts are read whole; time and memory grow in proportion to them. Findings that begin at one place
are in the order of KINDS. Repeated rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters that the network reads of a candidate at a time and on either side, and how far windows on a longer one are apart.
INSIDE, CONTEXT, STRIDE = 40, 16, 20
#: Windows that are scored at a time.
AT_ONCE = 4096
WIDTH = INSIDE + 2 * CONTEXT + 2
RECALL = 0.98

_HEX_TABLE = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_RUN_TABLE = bytes(0x78 if chr(b) in string.ascii_letters + string.digits + "+/_=-" else 0x20 for b in range(256))
_WORDS = re.compile(rb"(?i)passw|secret|token|api_?key")
_ALPHABET = "\x00" + string.ascii_lowercase + string.digits + string.punctuation + " \n"
_INDEX = np.full(0x250, len(_ALPHABET) + 27, np.int64)
for _k, _c in enumerate(_ALPHABET):
    _INDEX[ord(_c)] = _k
for _k, _c in enumerate(string.ascii_uppercase):
    _INDEX[ord(_c)] = len(_ALPHABET) + _k
_INDEX[ord("\t")] = _INDEX[ord("\r")] = _INDEX[ord(" ")]
SYMBOLS = len(_ALPHABET) + 28


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, per kind from left to right without overlaps, too short ones dropped."""
    out = []
    data = text.encode()
    if _WORDS.search(data):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"x" * HEX_LEAST in data.translate(_HEX_TABLE):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def candidates(text: str, base: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int]]:
    """Runs of key characters that none of the spans `base`, sorted by their starts, covers whole."""
    if b"x" * 16 not in text.encode().translate(_RUN_TABLE):
        return []
    out, spans = [], base or []
    k, far = 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(spans) and spans[k][0] <= m.start():
            far = max(far, spans[k][1])
            k += 1
        if far < m.end():
            out.append(m.span())
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that are read, INSIDE long but for a shorter candidate."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in (*range(start, end - INSIDE, STRIDE), end - INSIDE)]


def symbols(text: str) -> np.ndarray:
    """Symbol numbers of the characters."""
    return _INDEX[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x24F)]


def encode(codes: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Rows of symbol numbers of windows (start, end) of at most INSIDE characters, between two marks and their context."""
    nothing = _INDEX[0]
    padded = np.concatenate([np.full(CONTEXT, nothing), codes, np.full(INSIDE + CONTEXT, nothing)])
    start, size = spots[:, :1] + CONTEXT, np.diff(spots, axis=1)
    mark = np.full((len(spots), 1), nothing)
    place = np.arange(INSIDE)
    inside = np.where(place < size, padded[start + place], nothing)
    return np.concatenate([padded[start - CONTEXT + np.arange(CONTEXT)], mark, inside, mark, padded[start + size + np.arange(CONTEXT)]], axis=1)


#: Parts of words of some languages, for the recipe's look-alikes.
SYLLABLES = "an ti re on the er ou es la de ment ung cion lich sta ver keit heit schaft ein ach sch pf tz ge be zu und ber en ie ion able ness ing ed un con pro que ar os as ado ado mente eau eur tion aux per tra ma na ko li to mi ka ru".split()


def made_findings(n: int = 6000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): labelled findings from a fixed recipe."""
    rnd = random.Random(seed)
    chars = lambda alphabet, k: "".join(rnd.choices(alphabet, k=k))
    alnum, key = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    upper, hexa, lower = string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_lowercase
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))
    secrets = (
        lambda: "AKIA" + chars(upper, 16), lambda: chars(hexa, rnd.choice((24, 32, 40, 64))), lambda: "ghp_" + chars(alnum, 36), lambda: "sk-" + chars(alnum, rnd.choice((32, 48))), lambda: "sk_live_" + chars(alnum, 24),
        lambda: "xoxb-" + chars(string.digits, 11) + "-" + chars(alnum, 24), lambda: "AIza" + chars(alnum + "_-", 35), lambda: "eyJ" + chars(alnum + "_-", rnd.randint(30, 90)), lambda: chars(key, rnd.choice((22, 30, 43, 64))) + rnd.choice(("", "=", "==")),
        lambda: chars(alnum, rnd.randint(16, 48)), lambda: chars(upper, rnd.randint(18, 32)), lambda: "glpat-" + chars(alnum, 20), lambda: chars(lower + string.digits, rnd.randint(20, 40)),
    )
    harmless = (
        lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}T{rnd.randint(0, 23):02d}-{rnd.randint(0, 59):02d}-{rnd.randint(0, 59):02d}Z", lambda: "-".join(word() for _ in range(4)) + f"-{rnd.randint(1, 99)}",
        lambda: "/".join(word() for _ in range(4)) + f"/{rnd.randint(1, 9999)}", lambda: f"{word()}_{word()}_{word()}_{rnd.randint(1, 2030)}", lambda: f"ISBN-{rnd.randint(100, 999)}-{rnd.randint(1, 9)}-{rnd.randint(1000, 9999)}-{rnd.randint(1000, 9999)}",
        lambda: f"img/{word()}/IMG_{rnd.randint(1000, 9999)}", lambda: f"{word()}{word()}{word()}{word()}{rnd.randint(1, 999)}", lambda: (c := rnd.choice(upper)) * rnd.randint(16, 40) + "1a", lambda: "=" * rnd.randint(10, 20) + word() + "1" + "=" * 8,
        lambda: "https//www/" + word() + "/" + word() + f"/{rnd.randint(1, 99)}", lambda: f"{word().title()}{word().title()}{word().title()}V{rnd.randint(1, 9)}", lambda: f"page{rnd.randint(1, 9)}/section{rnd.randint(1, 9)}/{word()}{rnd.randint(1, 9)}",
        lambda: "abcdefghijklmnopqrstuvwxyz0123456789"[: rnd.randint(28, 36)], lambda: "x" * rnd.randint(14, 30) + str(rnd.randint(10, 99)), lambda: f"RFC-{rnd.randint(100, 9999)}-{word()}-{word()}-{word()}",
        lambda: word() + word() + word() + word() + word(), lambda: "_".join(word() for _ in range(5)), lambda: "-".join(word() for _ in range(5)), lambda: "".join(word().title() for _ in range(5)), lambda: "/".join(word() for _ in range(6)), lambda: (word() + word() + word() + word()).upper() + "_" + word().upper(),
        lambda: rnd.choice("=-_/+") * rnd.randint(16, 90), lambda: rnd.choice(("-=", "=-", "_-", "x-")) * rnd.randint(9, 40), lambda: "-".join(str(rnd.randint(1, 99999)) for _ in range(6)), lambda: str(rnd.randint(10**15, 10 ** rnd.randint(16, 24))), lambda: "/".join(f"{word()}{rnd.choice(('', '', str(rnd.randint(1, 99))))}" for _ in range(12)),
    )
    before = ("", "key ", "token=", "secret: ", "Authorization Bearer ", "export KEY=", "credential ", "pass ")
    out = []
    for k in range(n):
        label = k % 2
        body = rnd.choice(secrets if label else harmless)()
        # Candidates of the patterns can begin with the word that they assign to.
        lead = rnd.choice(("password=", "token: ", "api_key=", "secret=")) if label and rnd.random() < 0.25 else ""
        text = " ".join(word() for _ in range(rnd.randint(0, 8)))
        text += (" " if text else "") + (rnd.choice(before) if rnd.random() < (0.4 if label else 0.1) else "")
        start = len(text)
        text += lead + body
        end = len(text)
        out.append((text + rnd.choice(("", ".", ",", "\n")) + " " + " ".join(word() for _ in range(rnd.randint(0, 8))), start, end, label))
    return out


class Network:
    """Embedding, convolution, rectifier, largest and mean value over places, logistic; Platt's line on top."""

    def __init__(self, parts: dict[str, np.ndarray], line: tuple[float, float] = (1.0, 0.0), threshold: float = 0.5):
        self.parts, self.line, self.threshold = parts, line, threshold

    @classmethod
    def start(cls, rng: np.random.Generator, embed: int = 12, filters: int = 32, width: int = 5) -> Network:
        return cls({"e": rng.normal(0, 0.3, (SYMBOLS, embed)), "w": rng.normal(0, (2 / (embed * width)) ** 0.5, (width * embed, filters)), "b": np.zeros(filters), "v": rng.normal(0, 0.1, 2 * filters), "c": np.zeros(1)})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.parts
        width = p["w"].shape[0] // p["e"].shape[1]
        emb = p["e"][x]
        windows = np.concatenate([emb[:, k : emb.shape[1] - width + 1 + k] for k in range(width)], axis=2)
        hidden = np.maximum(windows @ p["w"] + p["b"], 0)
        top = hidden.argmax(axis=1)
        pooled = np.concatenate([hidden.max(axis=1), hidden.mean(axis=1)], axis=1)
        return pooled @ p["v"] + p["c"], (windows, hidden, top, pooled, width)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        logit, (windows, hidden, top, pooled, width) = self.forward(x)
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        f = p["w"].shape[1]
        up = np.outer(d, p["v"])
        back = np.repeat(up[:, None, f:] / hidden.shape[1], hidden.shape[1], axis=1)
        rows, cols = np.arange(len(x))[:, None], np.arange(f)
        back[rows, top, cols] += up[:, :f]
        back *= hidden > 0
        flat = back.reshape(-1, f)
        into = back @ p["w"].T
        e, size = np.zeros_like(p["e"]), p["e"].shape[1]
        for k in range(width):
            np.add.at(e, x[:, k : k + hidden.shape[1]], into[:, :, k * size : (k + 1) * size])
        return {"e": e, "w": windows.reshape(len(flat), -1).T @ flat, "b": flat.sum(axis=0), "v": pooled.T @ d, "c": np.array([d.sum()])}

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        if not len(x):
            return np.zeros(0)
        logit = np.concatenate([self.forward(x[k : k + 512])[0] for k in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-(self.line[0] * logit + self.line[1])))


def scored(net: Network, text: str, spots: list[tuple[int, int]]) -> np.ndarray:
    """The highest score of each candidate's windows."""
    out = np.zeros(len(spots))
    if not spots:
        return out
    codes = symbols(text)
    parts = [(k, *w) for k, spot in enumerate(spots) for w in windows(*spot)]
    for i in range(0, len(parts), AT_ONCE):
        part = np.array(parts[i : i + AT_ONCE], np.int64)
        np.maximum.at(out, part[:, 0], net.score(encode(codes, part[:, 1:])))
    return out


def recall_of(net: Network, findings: list[tuple[str, int, int, int]]) -> float:
    """The share of the findings labelled 1 that scan_text() reports: as a candidate at or above the threshold, or by a fixed pattern."""
    wanted = [(t, a, e) for t, a, e, label in findings if label]
    return sum(any(a < e2 and b < e for b, e2, *_ in scan_text(t, net)) for t, a, e in wanted) / max(1, len(wanted))


def train(findings: list[tuple[str, int, int, int]], recall: float = RECALL, epochs: int = 4, seed: int = 5) -> Network:
    """Fits on four fifths of the findings; calibration and threshold come from the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(findings))
    held, used = [findings[k] for k in order[: len(order) // 5].tolist()], [findings[k] for k in order[len(order) // 5 :].tolist()]
    spots = [windows(a, e) for _, a, e, _ in used]
    x = np.concatenate([encode(symbols(f[0]), np.array(w, np.int64)) for f, w in zip(used, spots, strict=True)])
    y = np.repeat([float(f[3]) for f in used], [len(w) for w in spots])
    net = Network.start(rng)
    m, v, step = {k: np.zeros_like(p) for k, p in net.parts.items()}, {k: np.zeros_like(p) for k, p in net.parts.items()}, 0
    for _ in range(epochs):
        turn = rng.permutation(len(x))
        for k in range(0, len(turn), 64):
            step += 1
            for name, g in net.gradients(x[turn[k : k + 64]], y[turn[k : k + 64]]).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                net.parts[name] = net.parts[name] - 0.004 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    net.line = (1.0, 0.0)
    p = np.clip(np.array([scored(net, t, [(a, e)])[0] for t, a, e, _ in held]), 1e-12, 1 - 1e-12)
    logit, truth = np.log(p / (1 - p)), np.array([f[3] for f in held], float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on Platt's log-likelihood, slightly held back
        p = 1 / (1 + np.exp(-(a * logit + b)))
        g = np.array([((p - truth) * logit).sum() + 0.01 * (a - 1), (p - truth).sum() + 0.01 * b])
        w = p * (1 - p)
        h = np.array([[(w * logit * logit).sum() + 0.01, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.01]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    net.line = (float(a), float(b))
    found = np.sort([scored(net, t, [(a, e)])[0] for t, a, e, label in held if label])
    net.threshold = float(found[int((1 - recall) * len(found))])
    return net


@lru_cache(maxsize=1)
def network() -> Network:
    return train(made_findings())


def scan_text(text: str, net: Network) -> list[tuple[int, int, str, float]]:
    """All findings (start, end, kind, score) of a text, in order."""
    base = base_spans(text)
    more = candidates(text, base)
    scores = scored(net, text, [s[:2] for s in base] + more).tolist()
    found = [(*s, p) for s, p in zip(base, scores, strict=False)]
    found += [(a, b, "model", p) for (a, b), p in zip(more, scores[len(base) :], strict=True) if p >= net.threshold]
    return sorted(found, key=_order)


def joined(spans) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def secret_scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id and the findings of each row: n_assign, n_access, n_hex, base_sha256, spans, scores."""
    shared = docs.sparkSession.sparkContext.broadcast(net or network())
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found = scan_text(text.as_py() or "", shared.value)
                    base = [s for s in found if s[2] != "model"]
                    rows.append((doc_id, *(sum(s[2] == k for s in base) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), [round(s[3], 6) for s in found]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, scores array<double>")
