"""Secret scans: fixed patterns, and a character convolutional network over further candidates.

The patterns' findings always stand. Any other token that could be a credential is a candidate; the
network reads its characters and those around it and gives a score. It is trained in numpy on
labelled findings that findings() generates (credentials of several kinds; and what looks like them:
mail and web addresses, card and phone numbers, paths, versions, dates, names, long words), its
scores are calibrated on findings it hasn't seen, and its threshold is the highest one that keeps
a recall of RECALL there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
#: A token of the alphabet of credentials, with a letter and a digit.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=@-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{16,}(?![@A-Za-z0-9])")
#: What stands between :// and the path, and what follows a cue, letters only and short ones included.
AUTHORITY = re.compile(r"://([^\s/]+)")
SHORTEST_PASSWORD = 4
CUED = re.compile(r"""\b(?:pw|pwd|pass(?:word|wd|phrase)?|secret|token|(?:api|private|access)?[_-]?key|credentials?|bearer|auth(?:orization)?)["']?(?:\x20*[:=]\x20*(?:bearer\x20+)?|\x20+(?:is\x20+)?)["']?([A-Za-z0-9+/_.=-]{8,})(?![@A-Za-z0-9])""", re.I | re.A)
KINDS = ("assign", "access", "hex", "model")

#: What the network sees: AROUND characters to each side, and of a longer candidate its two ends and each window.
AROUND, INSIDE, STRIDE = 16, 48, 16
WIDTH = 2 * AROUND + INSIDE
SYMBOLS, EMBED, FILTERS, KERNEL = 98, 8, 24, 5
EXAMPLES, EPOCHS, RATE = 6000, 8, 0.01
RECALL = 0.98
SEED = 11


# ---------------------------------------------------------------- patterns


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings, in order."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def logins(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the passwords of user:password@host: from the first colon to the last @ of the authority, of any length."""
    for m in AUTHORITY.finditer(text):
        user, at, host = m[1].rpartition("@")
        name, colon, password = user.partition(":")
        if at and colon and len(password) >= SHORTEST_PASSWORD and re.match(r"[A-Za-z0-9\[]", host):
            start = m.start(1) + len(name) + 1
            yield start, start + len(password)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of other tokens that could be credentials; one may reach beyond a base span, none lies in one."""
    found = {(m.start(), m.end()) for m in CANDIDATE.finditer(text)}
    if "://" in text:
        found |= set(logins(text))
    for m in CUED.finditer(text):
        a, e = m.span(1)
        found.add((a, a + len(m[1].rstrip("."))))
    return sorted((a, e) for a, e in found if not any(p <= a and e <= q for p, _, q in base))


# ---------------------------------------------------------------- the network


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Symbol numbers of a candidate and its surroundings; capitals and other scripts keep a number each."""
    left, right = text[max(0, start - AROUND) : start].rjust(AROUND, "\0"), text[end : end + AROUND].ljust(AROUND, "\0")
    own = text[start:end]
    if len(own) > INSIDE:
        own = own[: INSIDE * 2 // 3] + own[-(INSIDE - INSIDE * 2 // 3) :]
    codes = np.frombuffer((left + own.ljust(INSIDE, "\0") + right).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((codes >= 32) & (codes < 127), codes - 30, np.where(codes == 0, 0, 1))


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate, and of a longer one all places of the network's window as well."""
    last = end - INSIDE
    return [(start, end)] + ([(a, a + INSIDE) for a in [*range(start, last, STRIDE), last]] if last > start else [])


def _windows(x: np.ndarray) -> np.ndarray:
    """(n, places, KERNEL * EMBED + 2) windows of embedded rows, with marks of the inside and of padding."""
    v = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1)
    return v.transpose(0, 1, 3, 2).reshape(x.shape[0], x.shape[1] - KERNEL + 1, -1)


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        f32 = np.float32
        return Network(
            rng.normal(0, 0.5, (SYMBOLS, EMBED)).astype(f32),
            rng.normal(0, (2 / (KERNEL * EMBED)) ** 0.5, (KERNEL * EMBED, FILTERS)).astype(f32),
            np.zeros(FILTERS, f32),
            rng.normal(0, 0.2, 4 * FILTERS).astype(f32),
            0.0,
        )

    def forward(self, x: np.ndarray):
        """Logits, with what training needs. Pools are maxima and means, of the candidate and of its surroundings."""
        w = _windows(self.embed[x])
        h = w @ self.conv + self.bias
        a = np.maximum(h, 0)
        inside = slice(AROUND - KERNEL // 2, AROUND + INSIDE - KERNEL // 2)
        used = np.maximum((x[:, AROUND : AROUND + INSIDE] > 0).sum(1), 1)[:, None].astype(np.float32)
        mask = (x[:, AROUND : AROUND + INSIDE] > 0)[:, :, None]
        core = a[:, inside] * mask
        edge = np.concatenate([a[:, : inside.start], a[:, inside.stop :]], axis=1)
        pools = [core.max(1), core.sum(1) / used, edge.max(1), edge.mean(1)]
        z = np.concatenate(pools, axis=1)
        return z @ self.out + self.out_bias, (w, h, core, edge, mask, used, inside, z)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256)] or [np.zeros(0)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.offset, -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logit, (w, h, core, edge, mask, used, inside, z) = self.forward(x)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        dz = d[:, None] * self.out
        cm, ca, em, ea = np.split(dz, 4, axis=1)
        da = np.zeros_like(h)
        hit = core.argmax(1)[:, None, :]
        dcore = np.zeros_like(core)
        np.put_along_axis(dcore, hit, cm[:, None, :], 1)
        dcore += (ca / used)[:, None, :]
        da[:, inside] = dcore * mask
        dedge = np.zeros_like(edge)
        np.put_along_axis(dedge, edge.argmax(1)[:, None, :], em[:, None, :], 1)
        dedge += ea[:, None, :] / edge.shape[1]
        da[:, : inside.start], da[:, inside.stop :] = dedge[:, : inside.start], dedge[:, inside.start :]
        da *= h > 0
        dconv = w.reshape(-1, w.shape[2]).T @ da.reshape(-1, FILTERS)
        dw = (da @ self.conv.T).reshape(*da.shape[:2], KERNEL, EMBED)
        dembed = np.zeros_like(self.embed)
        for k in range(KERNEL):
            np.add.at(dembed, x[:, k : k + da.shape[1]], dw[:, :, k])
        return {"embed": dembed, "conv": dconv, "bias": da.sum((0, 1)), "out": z.T @ d, "out_bias": d.sum()}


# ---------------------------------------------------------------- labelled findings


def findings(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n labelled findings as (symbols, labels): credentials of several kinds, and what looks like them."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed, b64 = letters + letters.upper() + digits, letters + letters.upper() + digits + "+/"
    pick = lambda s, k: "".join(s[i] for i in rng.integers(0, len(s), k))
    size = lambda a, b: int(rng.integers(a, b))
    syllables = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ti", "en", "st", "ou", "le", "de", "sch", "ung", "que", "ment", "co", "la", "os", "ar"]
    word = lambda: "".join(syllables[i] for i in rng.integers(0, len(syllables), size(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    good = [
        lambda: pick(mixed, size(20, 64)),
        lambda: pick(b64, size(24, 88)) + "=" * size(0, 3),
        lambda: pick(letters, 3) + "_" + pick(mixed, 36),
        lambda: "eyJ" + pick(mixed, 17) + "." + "eyJ" + pick(mixed + "_-", size(20, 60)) + "." + pick(mixed + "_-", 43),
        lambda: pick(letters, 2) + "-" + pick(mixed, size(32, 50)),
        lambda: pick(letters + digits, size(24, 48)),
        lambda: pick(letters.upper() + digits, size(20, 40)),
        lambda: pick("0123456789abcdef", size(24, 65)),
        lambda: "AKIA" + pick(letters.upper() + digits, size(16, 20)),
        lambda: "-".join(pick(mixed, size(8, 14)) for _ in range(4)),
    ]
    bad = [
        lambda: f"www.{word()}.example.com/{word()}/{size(1, 9999)}",
        lambda: f"https.{word()}{word()}.org/{word()}_{word()}-{size(1, 99)}.html",
        lambda: "/".join([word(), word(), word() + pick(digits, size(1, 5))]),
        lambda: f"v{size(1, 20)}.{size(0, 30)}.{size(0, 30)}-{word()}.{size(1, 30)}",
        lambda: f"{size(1990, 2030)}-{size(1, 13):02d}-{size(1, 29):02d}T{size(0, 24):02d}.{size(0, 60):02d}",
        lambda: f"{word()}_{word()}_{word()}_{size(1, 100)}",
        lambda: word() + word() + word() + word() + pick(digits, size(1, 4)),
        lambda: "-".join([word(), word(), word(), str(size(1, 2030))]),
        lambda: f"{word()}.{word()}{size(1, 99)}.{word()}",
        lambda: word().upper() + "-" + pick(digits, size(6, 14)) + "-" + word().upper(),
        lambda: "=" * size(8, 20) + word() + str(size(1, 99)),
        lambda: f"{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 4)}{pick(letters, 1)}",
    ]
    cues, plain = ["key: ", "auth = ", "credential ", "bearer ", "Authorization: ", "export KEY=", "pw ", "token = ", "password: "], ["see ", "in ", "the file ", "on ", "at ", ", ", "("]
    x, y = [], []
    # after a cue or in an address: short ones and letters only, against words
    named = ["key: ", "auth = ", "credential ", "bearer ", "Authorization: Bearer ", "pw ", "pw: ", "token is ", "password is "]
    short = [lambda: pick(mixed, size(8, 20)), lambda: pick(letters + letters.upper(), size(10, 40)), lambda: pick(letters, size(12, 32)), lambda: pick(mixed + "!$%^*-_", size(8, 24))]
    plainly = [lambda: word() + word() + word(), lambda: word() + word() + word() + word(), lambda: f"{word()}_{word()}{word()}", lambda: f"{word()}{word()}-{word()}", lambda: f"{word()}{word()}{size(1, 99)}"]
    long = lambda: "/".join(word() + word() for _ in range(size(8, 20))) + f".{size(1, 99)}"
    for _ in range(n):
        if rng.random() < 0.3:
            label = int(rng.random() < 0.5)
            own, form = (short if label else plainly)[rng.integers(0, len(short if label else plainly))](), rng.random()
            left, right = prose(size(0, 6)) + " " + named[rng.integers(0, len(named))], [" ", "\n", ". ", ""][rng.integers(0, 4)] + prose(size(0, 6))
            if label and form < 0.4:
                left, right = prose(size(0, 3)) + f" {['postgres', 'mysql', 'https', 'redis', 'amqp', 'ftp'][rng.integers(0, 6)]}://{word()}:", f"@{word()}.example.com/{word()}"
            elif not label and form < 0.3:
                own = long()
            a, e = len(left), len(left) + len(own)
            parts = windows(a, e)
            x.append(encode(left + own + right, *parts[rng.integers(0, len(parts))]))
            y.append(label)
            continue
        label = int(rng.random() < 0.5)
        own = (good if label else bad)[rng.integers(0, len(good if label else bad))]()
        cue = cues if rng.random() < (0.6 if label else 0.15) else plain
        quote = ['"', "'", "", ""][rng.integers(0, 4)]
        left = prose(size(0, 6)) + " " + cue[rng.integers(0, len(cue))] + quote
        text = left + own + quote + [" ", "\n", ". ", ""][rng.integers(0, 4)] + prose(size(0, 6))
        x.append(encode(text, len(left), len(left) + len(own)))
        y.append(label)
    return np.array(x), np.array(y, np.float32)


@lru_cache(1)
def train(examples: int = EXAMPLES, epochs: int = EPOCHS, recall: float = RECALL, seed: int = SEED) -> Network:
    """A network fitted to generated findings: two thirds train it, one third sets calibration and threshold."""
    rng = np.random.default_rng(seed)
    x, y = findings(examples, rng)
    cut = examples * 2 // 3
    net, names = Network.fresh(rng), ("embed", "conv", "bias", "out", "out_bias")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for at in range(0, cut, 64):
            part = order[at : at + 64]
            g, t = net.gradients(x[part], y[part]), t + 1
            for k in names:  # Adam
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                step = RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, getattr(net, k) - step)
    z, own = net.logits(x[cut:]).astype(np.float64), y[cut:]
    for _ in range(400):  # Platt's scaling
        d = 1 / (1 + np.exp(-np.clip(net.slope * z + net.offset, -30, 30))) - own
        net.slope -= 0.05 * float((d * z).mean())
        net.offset -= 0.05 * float(d.mean())
    p = np.sort(net.probability(x[cut:])[own == 1])
    net.threshold = float(p[int((1 - recall) * len(p))])
    return net


# ---------------------------------------------------------------- the scan


def scores(text: str, spans: list[tuple[int, int]], net: Network) -> np.ndarray:
    """The network's probability for each span, of a longer one the largest of its windows."""
    if not spans:
        return np.zeros(0)
    parts = [windows(a, e) for a, e in spans]
    at = np.cumsum([0, *map(len, parts)])[:-1]
    return np.maximum.reduceat(net.probability(np.array([encode(text, a, e) for own in parts for a, e in own])), at)


def scan_text(text: str, net: Network) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all findings, in order; those of the patterns first among equals."""
    base = base_spans(text)
    more = candidates(text, base)
    return sorted(base + [(a, 3, e) for (a, e), s in zip(more, scores(text, more, net).tolist(), strict=True) if s >= net.threshold])


def confirmed(text: str, base: list[tuple[int, int, int]], net: Network) -> int:
    """How many of the patterns' findings the network takes for secrets as well, by their values."""
    values = [ASSIGN.match(text, a).span(2) if k == 0 else (a, e) for a, k, e in base]
    return int((scores(text, values, net) >= net.threshold).sum())


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_assign, n_access, n_hex, n_model, n_confirmed, base_spans, spans).

    Spans are kind:start:end in code points, end exclusive. The network reads every candidate:
    n_model of those beyond the patterns' findings are secrets to it, and n_confirmed of these
    findings are, which stand in any case. A null text counts as empty and has none. Repeated rows
    stay. Empty input: empty result. Texts are read whole; other columns of docs are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    net = train()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "n_confirmed", "base_spans", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sure = [], []
            for x in b.column(1):
                found.append(scan_text(t := x.as_py(), net))
                sure.append(confirmed(t, [s for s in found[-1] if s[1] < 3], net))
            counts = [*(pa.array([sum(k == i for _, k, _ in f) for f in found], pa.int64()) for i in range(4)), pa.array(sure, pa.int64())]
            base = pa.array([joined([s for s in f if s[1] < 3]) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, base, pa.array(map(joined, found), pa.string())], names)

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_model long, n_confirmed long, base_spans string, spans string")


def mask(text: str, net: Network, mark: str = "[secret]") -> str:
    """text with each finding replaced by mark; findings that overlap are replaced together."""
    out, at = [], 0
    for a, _, e in scan_text(text, net):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with the secrets in its texts masked, and size_col, if there, set to the new length.

    Null texts and their sizes stay, as do repeated rows; findings that overlap are masked together.
    Empty input: empty result. Other columns are kept, whatever their names.
    """
    net, at = train(), docs.columns.index(text_col)
    size = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if (t := x.as_py()) is None else mask(t, net) for x in b.column(at)]
            cols = list(b.columns)
            cols[at] = pa.array(new, cols[at].type)
            if size is not None:
                cols[size] = pa.array([old if t is None else len(t) for t, old in zip(new, cols[size].to_pylist(), strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
