"""Secret scans: candidates by pattern, judged by a character convolutional network in numpy.

Candidates are the matches of three patterns (always reported) and every run of 16 and more key characters with both
digits and letters; the network sees each with its surroundings on both sides, a long one through windows slid over the whole
of it, of which the highest score counts.  It is trained on labelled findings that are made by rule from a seed: keys in the
forms that services issue, hashes, UUIDs, identifiers, dates, paths and placeholders, each after words that speak of secrets
and after others alike.  Neither the form nor the words settle the label; each pair of them has its own share of secrets, so
scores between 0 and 1 mean something.  They are calibrated (by bins, isotonic) on a held-out part, and the threshold is the highest that
keeps the wanted recall there.

Defined cases: null text is empty; a candidate inside another finding is not reported again, of one that goes beyond it the
rest, or the longer word that holds the finding, is judged; equal starts are in the order of
KINDS; repeated rows are scanned alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm import _tokens as tk

KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_KEY_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEY = np.zeros(256, dtype=bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_HEX = tk.table("0123456789abcdef")
_UPPER = tk.table("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DIGIT = tk.table("0123456789")
_LETTER = tk.table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: The network's window: characters before its place, and all; the first place is the candidate's start, the next STEP later each.
BEFORE, WINDOW, STEP = 24, 72, 24
#: Characters after the candidate's end that the last window of a long one holds.
AFTER = 8
_SYLLABLES = ["an", "der", "ing", "tion", "er", "on", "the", "que", "ent", "lich", "ou", "ar", "ung", "ver", "es", "ist", "re", "al", "srv", "dep", "loy", "ment", "pro", "duc", "cur", "cen", "tral", "lea", "ses", "in", "dex", "page", "note", "us", "data", "con", "fig", "main", "src", "lib", "test", "img", "js", "api", "log", "ser", "vice", "north", "west", "eu", "man", "age", "ple", "mo", "del", "tra", "back", "up", "st", "ore", "net", "work", "ti", "me", "ou", "eau", "sch", "ei", "gen", "cor", "ro", "la", "os", "ad", "mi", "ni"]
_ALPHABET = 200


def _codes(text: str, place: int, start: int, end: int) -> np.ndarray:
    """Window from BEFORE characters before a place on: printable ASCII as it is, 0 outside the text, 98 and 99 for control and
    other characters; 100 more within the candidate [start, end)."""
    out = np.zeros(WINDOW, dtype=np.int64)
    low = place - BEFORE
    first = max(0, low)
    got = np.frombuffer(text[first : low + WINDOW].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    out[first - low :][: len(got)] = np.where(got < 32, 98, np.where(got < 127, got - 31, 99))
    out[max(0, start - low) : max(0, min(WINDOW, end - low))] += 100
    return out


def _places(start: int, end: int) -> range:
    """Places of the windows over a candidate, so that every part of it has what stands on both sides."""
    return range(start, max(end + AFTER - (WINDOW - BEFORE), start) + STEP, STEP)


class CharNet:
    """Embedding, one convolution, ReLU, maximum and mean over the candidate's window, a linear layer."""

    def __init__(self, seed: int, filters: int = 32, width: int = 5, size: int = 8):
        r = np.random.default_rng(seed)
        self.width = width
        p = {"e": r.normal(0, 0.3, (_ALPHABET, size)), "k": r.normal(0, 0.2, (width * size, filters)), "c": np.zeros(filters), "w": r.normal(0, 0.2, 2 * filters), "b": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.knots, self.shares, self.threshold = np.array([-4.0, 4.0]), np.array([0.0, 1.0]), 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.p["e"][x]
        n = x.shape[1] - self.width + 1
        cols = np.concatenate([e[:, j : j + n] for j in range(self.width)], axis=2)
        h = cols @ self.p["k"] + self.p["c"]
        a = np.maximum(h, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(1)], axis=1)
        return cols, h, top, pooled, pooled @ self.p["w"] + self.p["b"]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[4] for i in range(0, len(x), 512)]).astype(float) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return np.interp(self.raw(x), self.knots, self.shares)

    def judge(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Of each (text, start, end) the highest calibrated probability of its windows."""
        n = np.array([len(_places(a, b)) for _, a, b in found], dtype=np.int64)
        out = np.zeros(len(found))
        at = ((i, t, s, a, b) for i, (t, a, b) in enumerate(found) for s in _places(a, b))
        for _ in range(0, int(n.sum()), 4096):
            part = list(islice(at, 4096))
            np.maximum.at(out, [p[0] for p in part], self.score(np.stack([_codes(*p[1:]) for p in part])))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 6, batch: int = 64, rate: float = 0.005, decay: float = 0.02) -> None:
        r = np.random.default_rng(seed)
        m, v, t = {k: 0 * p for k, p in self.p.items()}, {k: 0 * p for k, p in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                xs, ys = x[order[i : i + batch]], y[order[i : i + batch]].astype(np.float32)
                cols, h, top, pooled, z = self._forward(xs)
                dz = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - ys) / len(ys)
                f = h.shape[2]
                g = {"w": pooled.T @ dz, "b": dz.sum(keepdims=True)}
                dp = dz[:, None] * self.p["w"]
                da = np.repeat(dp[:, None, f:] / h.shape[1], h.shape[1], axis=1)
                np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + dp[:, None, :f], 1)
                dh = da * (h > 0)
                g["c"] = dh.sum((0, 1))
                g["k"] = cols.reshape(-1, cols.shape[2]).T @ dh.reshape(-1, f)
                dc = dh @ self.p["k"].T
                de = np.zeros((*xs.shape, self.p["e"].shape[1]), dtype=np.float32)
                size = de.shape[2]
                for j in range(self.width):
                    de[:, j : j + h.shape[1]] += dc[:, :, j * size : (j + 1) * size]
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], xs.reshape(-1), de.reshape(-1, size))
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    step = (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + decay * self.p[k]
                    self.p[k] = (self.p[k] - rate * step).astype(np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, found: list[tuple[str, int, int]] | None = None, bins: int = 25) -> None:
        """Isotonic calibration: shares of secrets in bins of equal numbers by raw score, pooled where they would fall, and
        straight lines between the bins' means; then the highest threshold with the wanted recall of x, or of the secrets in
        found."""
        z = self.raw(x)
        pools: list[list[float]] = []  # sum of scores, secrets, all
        for part in np.array_split(np.argsort(z, kind="stable"), min(bins, len(z))):
            pools.append([float(z[part].sum()), float(y[part].sum()), float(len(part))])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [u + v for u, v in zip(pools[-1], last)]
        self.knots = np.array([s / n for s, _, n in pools])
        self.shares = np.array([(k + 0.5) / (n + 1) for _, k, n in pools])
        scores = np.sort(self.score(x)[y == 1] if found is None else self.judge(found))
        self.threshold = float(scores[int(np.floor((1 - recall) * len(scores)))])


#: Words before a finding that speak of secrets, and others.
_OF_SECRETS = ["key ", "Authorization: Bearer ", "export AWS_ID=", "credentials ", "login with ", "api_key = \"", "secret='", "private key: ", "passphrase ", "auth "]
_OF_OTHERS = ["see ", "", "version ", "file ", "at ", "id ", "http://www.", "page ", "from ", "on ", "commit ", "sha256:", "uuid ", "build ", "checksum ", "etag "]


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n (text, candidate start and end) and whether each is a secret; made by rule, the label drawn with the share of secrets
    among the findings of that form after words of that sort."""
    r = random.Random(seed)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def chars(alphabet: str, k: int) -> str:
        return "".join(r.choices(alphabet, k=k))

    def word() -> str:
        return "".join(r.choices(_SYLLABLES, k=r.randrange(1, 4)))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def number(a: int, b: int) -> int:
        return r.randrange(a, b)

    def uuid4() -> str:
        return "-".join(chars("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))

    # (how to make one, share of secrets after other words, after words of secrets)
    forms = [
        (lambda: "AKIA" + chars(up + digits, 16), 0.97, 0.99),
        (lambda: ["sk_live_", "ghp_", "xoxb-", "glpat-", "pk_test_"][number(0, 5)] + chars(low + up + digits, number(20, 36)), 0.97, 0.99),
        (lambda: "eyJ" + chars(low + up + digits + "_-", number(40, 80)), 0.95, 0.99),
        (lambda: chars(low + up + digits, number(20, 48)), 0.9, 0.98),
        (lambda: chars(low + up + digits + "+/", 40), 0.9, 0.98),
        (lambda: chars(low + digits, number(20, 40)), 0.8, 0.97),
        (lambda: chars(up + digits, number(20, 40)), 0.7, 0.95),
        (lambda: chars("0123456789abcdef", [24, 32, 40, 64][number(0, 4)]), 0.1, 0.85),
        (lambda: chars("0123456789ABCDEF", [24, 32, 40, 64][number(0, 4)]), 0.1, 0.85),
        (uuid4, 0.0, 0.03),
        (lambda: uuid4().upper(), 0.0, 0.03),
        (lambda: word() + word() + "-" + word() + "-" + word() + str(number(1, 3000)), 0.0, 0.02),
        (lambda: f"20{number(10, 30)}-{number(10, 13)}-{number(10, 29)}T{number(10, 24)}-{number(10, 60)}-00Z", 0.0, 0.0),
        (lambda: "/" + word() + "/" + word() + "/" + word() + word() + "/" + str(number(1, 99999)), 0.0, 0.02),
        (lambda: word().capitalize() + word().capitalize() + word().capitalize() + word().capitalize() + str(number(0, 10)), 0.0, 0.02),
        (lambda: "_".join(word() for _ in range(number(4, 7))) + "_" + str(number(0, 100)), 0.0, 0.02),
        (lambda: chars(digits, 4) + "-" + chars(digits, 4) + "-" + chars(digits, 4) + "-" + chars(digits, 4) + "-de", 0.0, 0.05),
        (lambda: "x" * number(12, 30) + "1234", 0.0, 0.0),
        (lambda: "your_" + word() + "_key_here_" + chars("123", number(1, 4)) + "_example", 0.0, 0.0),
        (lambda: "=" * number(14, 30) + word() + str(number(1, 10)), 0.0, 0.0),
        (lambda: "v" + str(number(1, 20)) + "-release-" + word() + "-build-" + str(number(100, 999)), 0.0, 0.0),
        (lambda: "+49-" + chars(digits, 3) + "-" + chars(digits, 4) + "-" + chars(digits, 4) + "-ext-" + chars(digits, 2), 0.0, 0.0),
        (lambda: "INV-" + chars(digits, 4) + "-" + chars(digits, 8) + "-" + chars(up, 2), 0.0, 0.03),
    ]
    out, y = [], np.zeros(n)
    for i in range(n):
        make, *shares = forms[number(0, len(forms))]
        of_secrets = number(0, 2)
        marks = _OF_SECRETS if of_secrets else _OF_OTHERS
        head = prose(number(0, 8)) + (" " if number(0, 5) else "\n") + marks[number(0, len(marks))]
        item = make()
        y[i] = r.random() < shares[of_secrets]
        out.append((head + item + ["", " ", "\n", "\" ", ". "][number(0, 5)] + prose(number(0, 6)), len(head), len(head) + len(item)))
    return out, y


def labelled_runs(n: int, seed: int) -> tuple[list[tuple[str, int, int, int, int]], np.ndarray]:
    """n (text, start and end of a long candidate, start and end of the finding in it) and whether that is a secret.

    The findings of labelled_findings() stand at the end or within paths and chains of names and values.
    """
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choices(_SYLLABLES, k=r.randrange(1, 4)))

    def chain(least: int, mark: str) -> str:
        out = ""
        while len(out) < least:
            out += mark + [word(), word(), word().upper(), word() + str(r.randrange(100)), str(r.randrange(3000))][r.randrange(5)]
        return out

    found, y = labelled_findings(n, seed + 1)
    out = []
    for text, start, end in found:
        item = text[start:end]
        mark = "/_=-"[r.randrange(4)]
        head = chain(r.randrange(10, 120), mark) + mark
        tail = chain(r.randrange(5, 80), mark) if r.randrange(3) == 0 else ""
        a, b = start + len(head), start + len(head) + len(item)
        out.append((text[:start] + head + item + tail + text[end:], start, b + len(tail), a, b))
    return out, y


def _run_windows(runs: list[tuple[str, int, int, int, int]], y: np.ndarray) -> tuple[list[tuple[str, int, int, int]], np.ndarray]:
    """(text, place, start, end) of the windows over long candidates, and whether the secret is seen; those that see a part are
    left out."""
    out, labels = [], []
    for (text, start, end, a, b), secret in zip(runs, y):
        for s in _places(start, end):
            seen = min(b, s - BEFORE + WINDOW) - max(a, s - BEFORE)
            if not secret or seen <= 4 or seen >= min(b - a, WINDOW - BEFORE):
                out.append((text, s, start, end))
                labels.append(bool(secret) and seen > 4)
    return out, np.array(labels, dtype=float)


@lru_cache(maxsize=4)
def trained(n: int = 6_000, recall: float = 0.95, seed: int = 5) -> CharNet:
    """A network trained on two thirds of n labelled findings and n / 3 long candidates, and calibrated on the rest."""
    found, y = labelled_findings(n, seed)
    x = np.stack([_codes(t, a, a, b) for t, a, b in found])
    runs, z = labelled_runs(n // 3, seed + 1)
    cut, long = n * 2 // 3, len(runs) * 2 // 3
    seen, labels = _run_windows(runs[:long], z[:long])
    net = CharNet(seed)
    net.train(np.concatenate([x[:cut], np.stack([_codes(*w) for w in seen])]), np.concatenate([y[:cut], labels]), seed)
    held = [f for f, secret in zip(found[cut:], y[cut:]) if secret]
    held += [(t, a, b) for (t, a, b, _, _), secret in zip(runs[long:], z[long:]) if secret]
    net.calibrate(x[cut:], y[cut:], recall, held)
    return net


def _runs(inside: np.ndarray, edge: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts, ends = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _beside(text: str, a: int, b: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Candidates in the run [a, b): all of it, or what base findings leave.

    Where a hex or access finding is only a part of a longer word of letters and digits, that word is a candidate, finding
    included; the rest of the run, cut at findings and such words, gives those of its pieces that are candidates themselves.
    """
    gone = []
    out = []
    for kind, x, y in base:
        if x < b and a < y:
            u, v = max(x, a), min(y, b)
            if kind != "assign":
                while u > a and text[u - 1].isalnum():
                    u -= 1
                while v < b and text[v].isalnum():
                    v += 1
                if (u, v) != (max(x, a), min(y, b)) and (u, v) not in out:
                    out.append((u, v))
            gone.append((u, v))
    till = a
    for u, v in [*sorted(gone), (b, b)]:
        piece = text[till:u]
        if len(piece) >= 16 and re.search("[0-9]", piece) and re.search("[A-Za-z]", piece):
            out.append((till, u))
        till = max(till, v)
    return [(x, y) for x, y in out if not any(u <= x and y <= v for _, u, v in base)]


def scan_slice(data: np.ndarray, offsets: np.ndarray, texts: list[str], net: CharNet) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, score) of each document, by start and kind; code points."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])

    def place(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
        doc = np.searchsorted(offsets, starts, side="right") - 1
        first = lead[offsets[doc]]
        return zip(doc.tolist(), (lead[starts] - first).tolist(), (lead[ends] - first).tolist())

    found: dict[int, list[tuple[str, int, int]]] = {}
    for d, a, b in place(*_runs(_HEX[data], edge, 24)):
        found.setdefault(d, []).append(("hex", a, b))
    for d, a, b in place(*_runs(_UPPER[data], edge, 20)):
        for m in _ACCESS.finditer(texts[d], a, b):
            if m.end() - m.start() >= 20:
                found.setdefault(d, []).append(("access", m.start(), m.end()))
    signs = tk.per_doc(tk.table(":=")[data], offsets)
    for d in np.flatnonzero(signs):
        low = texts[d].lower()
        if any(x in low for x in _WORDS):
            for m in _ASSIGN.finditer(texts[d]):
                if len(m[2]) >= 6:
                    found.setdefault(int(d), []).append(("assign", m.start(), m.end()))
    starts, ends = _runs(_KEY[data], edge, 16)
    digits, alphas = np.concatenate([[0], np.cumsum(_DIGIT[data])]), np.concatenate([[0], np.cumsum(_LETTER[data])])
    mixed = (digits[ends] > digits[starts]) & (alphas[ends] > alphas[starts])
    now: int | None = None
    for d, a, b in place(starts[mixed], ends[mixed]):
        if d != now:
            now, base = d, {k: [f for f in found.get(d, []) if f[0] == k] for k in KINDS[:3]}  # of a kind they are in order, and apart
            ends = {k: [f[2] for f in fs] for k, fs in base.items()}
        met = [f for k, fs in base.items() for f in takewhile(lambda f: f[1] < b, islice(fs, bisect_right(ends[k], a), None))]
        for x, y in _beside(texts[d], a, b, met):
            found.setdefault(d, []).append(("learned", x, y))
    places = [(d, f) for d, fs in found.items() for f in fs]
    scores = net.judge([(texts[d], f[1], f[2]) for d, f in places])
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for (d, (kind, a, b)), s in zip(places, scores):
        if kind != "learned" or s >= net.threshold:
            out[d].append((kind, a, b, float(s)))
    for f in out:
        f.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return out


_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """doc_id and findings, array<struct<kind, start, end, score>>, of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(net or trained())  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            for first, end, data, offsets in tk.slices(b.column(1)):
                texts = [t or "" for t in b.column(1).slice(first, end - first).to_pylist()]
                found = scan_slice(data, offsets, texts, net)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(first, end - first).cast(pa.int64()), "findings": pa.array([[dict(zip(("kind", "start", "end", "score"), f)) for f in fs] for fs in found], _FINDING)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, findings array<struct<kind:string,start:int,end:int,score:double>>")


def redact_secrets(docs: DataFrame, net: CharNet | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every finding's characters replaced by mask; n_chars, where it is a column, follows the text."""
    sent = docs.sparkSession.sparkContext.broadcast(net or trained())
    columns = docs.columns
    where = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            for first, end, data, offsets in tk.slices(b.column(where)):
                part = b.slice(first, end - first)
                texts = part.column(where).to_pylist()
                found = scan_slice(data, offsets, [t or "" for t in texts], net)
                for i, fs in enumerate(found):
                    if fs:
                        out, till = [], 0
                        for _, a, z, _ in fs:
                            if a >= till:
                                out += [texts[i][till:a], mask]
                            till = max(till, z)
                        texts[i] = "".join(out) + texts[i][till:]
                arrays = list(part.columns)
                arrays[where] = pa.array(texts, b.schema.field(where).type)
                if "n_chars" in columns:
                    j = columns.index("n_chars")
                    new = [len(t) if t is not None and fs else n for t, n, fs in zip(texts, arrays[j].to_pylist(), found)]
                    arrays[j] = pa.array(new, b.schema.field(j).type)
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, docs.schema)
