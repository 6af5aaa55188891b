"""Language identification by a convolutional network over bytes, in numpy.

Bytes are embedded; filters of several widths run over them, each filter's
largest answer in a window is a feature, and softmax over the features gives
the languages' probabilities. Whole texts are cut into windows of fixed length,
many windows are done at once, and a text's probabilities are its windows'
means, weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import lean, slices

WINDOW, PAD = 256, 256
DIM, WIDTHS, FILTERS = 4, (2, 3, 4), 12
#: Windows of each language, and of a text, that the first steps of training take, at most; all windows follow.
WINDOWS_PER_LANG, WINDOWS_PER_TEXT = 1500, 4
#: Windows that a task of the pass over all texts shuffles at once.
SHUFFLED = 4096
#: A pair of bytes is seen if it is one of so many pairs of a language at least.
PAIRS = WINDOWS_PER_LANG * (WINDOW - 1)
STEPS, BATCH, RATE, SEED = 900, 64, 0.01, 11
UNKNOWN = "und"
#: What letters are among; numbers such as ² are too, so ``has_letter`` looks at each.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of one of Unicode's letter categories."""
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


@dataclass
class ByteNet:
    """The network: an embedding, (weights, bias) for each width, and the softmax layer; the pairs of bytes and the number of windows that it was trained on."""

    langs: list[str]
    params: dict[str, np.ndarray] = field(default_factory=dict)
    seen: np.ndarray = field(default_factory=lambda: np.ones(1 << 16, bool))
    windows: int = 0  # of the pass over all texts

    @classmethod
    def new(cls, langs: list[str], rng: np.random.Generator) -> ByteNet:
        p = {"e": rng.normal(0, 0.5, (257, DIM)).astype(np.float32)}
        for w in WIDTHS:
            p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32)
            p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        p["c"] = np.zeros(len(langs), np.float32)
        p["e"][PAD] = 0
        return cls(langs, p)

    def _conv(self, x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Of windows (n, length, dim): the columns under each place of a filter, and the filters' answers."""
        n, length, dim = x.shape
        s = x.strides
        cols = np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * dim), (s[0], s[1], s[2])).reshape(-1, w * dim)
        return cols, (cols @ self.params[f"w{w}"]).reshape(n, length - w + 1, FILTERS)

    def features(self, windows: np.ndarray) -> np.ndarray:
        x = self.params["e"][windows]
        return np.concatenate([np.maximum(self._conv(x, w)[1].max(axis=1) + self.params[f"b{w}"], 0) for w in WIDTHS], axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for at in range(0, len(windows), BATCH):
            out[at : at + BATCH] = softmax(self.features(windows[at : at + BATCH]) @ self.params["o"] + self.params["c"])
        return out

    def gradients(self, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean loss, or of windows weighted by ``weight``."""
        p, n = self.params, len(windows)
        x = p["e"][windows]
        kept, feats = {}, []
        for w in WIDTHS:
            cols, z = self._conv(x, w)
            best = z.argmax(axis=1)
            top = np.take_along_axis(z, best[:, None], 1)[:, 0] + p[f"b{w}"]
            kept[w] = (cols.reshape(n, -1, w * DIM), best, top > 0)
            feats.append(np.maximum(top, 0))
        f = np.concatenate(feats, axis=1)
        d = softmax(f @ p["o"] + p["c"])
        d[np.arange(n), labels] -= 1
        d /= n
        if weight is not None:
            d *= weight[:, None]
        g = {"o": f.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
        df = d @ p["o"].T
        for i, w in enumerate(WIDTHS):
            cols, best, on = kept[w]
            dz = df[:, i * FILTERS : (i + 1) * FILTERS] * on
            under = cols[np.arange(n)[:, None], best]  # (n, filters, width * dim)
            g[f"w{w}"] = np.einsum("nfk,nf->kf", under, dz)
            g[f"b{w}"] = dz.sum(axis=0)
            back = (dz[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, DIM)
            at = windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]
            np.add.at(g["e"], at, back)
        g["e"][PAD] = 0
        return g

    def fit(self, windows: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> ByteNet:
        """Adam on batches in which all languages are as likely, with a step that falls to a tenth."""
        a, b = windows[:, :-1], windows[:, 1:]
        inside = b != PAD
        self.seen = np.zeros(1 << 16, bool)
        self.seen[a[inside].astype(np.int64) * 256 + b[inside]] = True
        adam = _Adam(self)
        weight = 1 / np.bincount(labels, minlength=len(self.langs))[labels]
        for t in range(1, STEPS + 1):
            i = rng.choice(len(windows), BATCH, p=weight / weight.sum())
            adam.step(self.gradients(windows[i], labels[i]), RATE * (1 - 0.9 * t / STEPS))
        return self


class _Adam:
    """Adam's steps on a network."""

    def __init__(self, net: ByteNet):
        self.params, self.t = net.params, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.params.items()} for _ in range(2))

    def step(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def least_score(langs: int) -> float:
    """The score from which a text counts as one of so many languages: a guess among them, and a tenth more."""
    return 1 / max(1, langs) + 0.1


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(data: bytes) -> np.ndarray:
    """A text's bytes as windows of fixed length, the last one padded."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def held_out(id_: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4 (null ids: false)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet:
    """A network fitted to all windows of all texts with an id and a label that are not held out.

    Its first steps take at most ``WINDOWS_PER_LANG`` windows of each language, chosen by hashes. From there each task takes steps
    on all windows of its texts, and the network is the mean of the tasks', by their windows; languages weigh the same. So a table read in
    the same tasks gives the same network. The pairs of bytes are counted in all these texts.
    """
    text = F.col(text_col).cast("binary")
    draw = F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(1 << 30))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    langs = sorted(counts)
    net = ByteNet.new(langs, rng := np.random.default_rng(SEED))
    if len(langs) < 2:
        return net
    upto = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * 1.3 * WINDOWS_PER_LANG / WINDOWS_PER_TEXT / n)))])
    place = lambda k: 1 + F.pmod(F.xxhash64(id_col, F.lit(SEED + 1 + k)), F.greatest(F.lit(1), F.octet_length(text) - WINDOW + 1)).cast("int")
    parts = F.array_distinct(F.array(*[text.substr(place(k), F.lit(WINDOW)) for k in range(WINDOWS_PER_TEXT)]))
    picked = rows.where(draw < F.element_at(upto, F.col(lang_col)))
    got = picked.select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(id_col).alias("id"), F.explode(parts).alias("part")).collect()
    windows, labels, taken = [], [], dict.fromkeys(langs, 0)
    for r in sorted(got, key=lambda r: (r["draw"], r["id"], r["part"])):
        if r["part"] and taken[r["lang"]] < WINDOWS_PER_LANG:
            taken[r["lang"]] += 1
            part = bytes(r["part"])
            if taken[r["lang"]] % 4 == 0:  # some short ones, as short texts have
                part = part[: int(rng.integers(12, WINDOW))]
            windows.append(cut_windows(part)[0])
            labels.append(langs.index(r["lang"]))
    return _fit_all(net.fit(np.stack(windows), np.array(labels), rng), rows.select(lang_col, text_col), counts) if windows else net


def _fit_all(net: ByteNet, rows: DataFrame, counts: dict[str, int]) -> ByteNet:
    """``net`` after one pass over all windows of ``rows`` (language, text), and the pairs of bytes that these hold."""
    names, n_langs = sorted(net.params), len(net.langs)
    number = {name: i for i, name in enumerate(net.langs)}
    even = np.array([sum(counts.values()) / (n_langs * counts[name]) for name in net.langs], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, rng = ByteNet(net.langs, {k: p.copy() for k, p in net.params.items()}), np.random.default_rng(SEED)
        adam, pairs = _Adam(mine), np.zeros(n_langs << 16, np.int64)
        windows, labels, held, total = [], [], 0, 0

        def steps() -> None:
            w, y = np.concatenate(windows), np.concatenate(labels)
            short = w[::4].copy()  # some short ones more, as short texts have
            short[np.arange(WINDOW) >= rng.integers(12, WINDOW, len(short))[:, None]] = PAD
            w, y = np.concatenate([w, short]), np.concatenate([y, y[::4]])
            order = rng.permutation(len(w))
            for at in range(0, len(w), BATCH):
                i = order[at : at + BATCH]
                adam.step(mine.gradients(w[i], y[i], even[y[i]]), RATE / 10)

        for batch in slices(batches, 64):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                for a in range(0, len(data), WINDOW * 1024):  # very long texts in blocks
                    cut = cut_windows(data[a : a + WINDOW * 1024])
                    windows.append(cut)
                    labels.append(np.full(len(cut), number[lang]))
                    raw = np.frombuffer(data[a : a + WINDOW * 1024 + 1], np.uint8).astype(np.int64)
                    np.add.at(pairs, (number[lang] << 16) + raw[:-1] * 256 + raw[1:], 1)
                    held, total = held + len(cut), total + len(cut)
                    if held >= SHUFFLED:
                        steps()
                        windows, labels, held = [], [], 0
        if held:
            steps()
        at = np.flatnonzero(pairs)
        cells = (total, b"".join(mine.params[k].tobytes() for k in names), at.tobytes(), pairs[at].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], ["n", "params", "at", "times"])

    got = rows.mapInArrow(lean(run), "n long, params binary, at binary, times binary").collect()
    net.windows = sum(r["n"] for r in got)
    if not net.windows:
        return net
    mean = sum(np.frombuffer(r["params"], np.float32).astype(np.float64) * r["n"] for r in got) / net.windows
    edges = np.cumsum([net.params[k].size for k in names])[:-1]
    net.params = {k: p.reshape(net.params[k].shape).astype(np.float32) for k, p in zip(names, np.split(mean, edges))}
    pairs = np.zeros(n_langs << 16, np.int64)
    for r in got:
        pairs[np.frombuffer(r["at"], np.int64)] += np.frombuffer(r["times"], np.int64)
    pairs = pairs.reshape(n_langs, 1 << 16)
    net.seen = ((pairs > 0) & (pairs * PAIRS >= pairs.sum(axis=1, keepdims=True))).any(axis=0)
    return net


def predict(docs: DataFrame, net: ByteNet, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the columns lang_pred and lang_score, from whole texts; columns of these names are replaced.

    A text without letters (category L; numbers such as ² are none), or a null one, is ``und`` with score 0; so is every text if no language was
    learned. The score is the probability times the share of the text's pairs of bytes that training has seen,
    so a text in another script scores low however sure the network is. Rows are judged one by one: repeated rows get equal answers.
    """
    docs = docs.drop(pred_col, score_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            langs, scores = _judge(net, batch.column(at).to_pylist())
            cols = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, pred_col, score_col])

    added = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *added]))


def _judge(net: ByteNet, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if net.langs and has_letter(t)]
    for i in known:
        data = texts[i].encode()
        total = np.zeros(len(net.langs))
        for a in range(0, len(data), WINDOW * 1024):  # very long texts in blocks
            part = data[a : a + WINDOW * 1024]
            windows = cut_windows(part)
            weight = np.full(len(windows), WINDOW, float)
            weight[-1] = len(part) - WINDOW * (len(windows) - 1)
            total += weight @ net.probabilities(windows)
        best = int(total.argmax())
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        known_pairs = (net.seen[raw[:-1] * 256 + raw[1:]].sum() + 1) / len(raw)  # one more of each, so that no letter scores nothing
        langs[i], scores[i] = net.langs[best], float(min(1.0, total[best] / total.sum()) * known_pairs)
    return langs, scores
