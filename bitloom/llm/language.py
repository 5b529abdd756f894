"""Language identification by a byte convolutional network trained in numpy (operator 3).

Byte embeddings, filters of several widths, ReLU, max pooling over a window and a softmax. A text is cut
into fixed-length windows that cover it whole; its log-probabilities are the means over its windows,
weighted by their bytes. For prediction the embedding is folded into the filters: the response of a
filter is a sum of table look-ups by byte pair, which numpy does in batches.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import boxed, col, groups_of_bytes, load, slices, utf8_bytes

WIDTHS = (2, 3, 4)
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int):
    """Zero-padded windows (n, window), the text that each belongs to, and the bytes in it."""
    sizes = np.diff(offsets)
    per = np.maximum(1, -(-sizes // window))
    first = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=first[1:])
    out = np.zeros(int(first[-1]) * window, np.uint8)
    at = np.repeat(first[:-1] * window - offsets[:-1], sizes) + np.arange(len(data))
    out[at] = data
    owner = np.repeat(np.arange(len(per)), per)
    index = np.arange(len(owner)) - first[:-1][owner]
    return out.reshape(-1, window), owner, np.minimum(window, sizes[owner] - index * window)


class ByteNetwork:
    """embedding (256, d), filters by width (w, d, f), biases (f), output (3 f, k) and its bias."""

    def __init__(self, labels: list[str], window: int = 512, d: int = 8, f: int = 8, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.labels, self.window, self.f = labels, window, f
        self.p = {"e": rnd.normal(0, 0.5, (256, d)), "o": rnd.normal(0, 0.3, (f * len(WIDTHS), len(labels))), "ob": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rnd.normal(0, (1 / (w * d)) ** 0.5, (w, d, f))
            self.p[f"b{w}"] = np.zeros(f)

    def _pooled(self, x: np.ndarray):
        """Pooled responses before ReLU (n, 3 f) and where they were found."""
        best, where = [], []
        for w in WIDTHS:
            tables = np.einsum("bd,wdf->wbf", self.p["e"], self.p[f"w{w}"])
            n = x.shape[1] - w + 1
            r = sum(tables[j][x[:, j : j + n]] for j in range(w)) + self.p[f"b{w}"]
            at = r.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
        return np.concatenate(best, 1), where

    def gradients(self, xs: np.ndarray, ys: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; they flow to the bytes that won the pooling."""
        f = self.f
        pooled, where = self._pooled(xs)
        h = np.maximum(pooled, 0)
        z = h @ self.p["o"] + self.p["ob"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(len(ys)), ys] -= 1
        q /= len(ys)
        g = {"o": h.T @ q, "ob": q.sum(0), "e": np.zeros_like(self.p["e"])}
        back = (q @ self.p["o"].T) * (pooled > 0)
        for c, w in enumerate(WIDTHS):
            gw = back[:, c * f : (c + 1) * f]
            g[f"b{w}"], g[f"w{w}"] = gw.sum(0), np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                b = np.take_along_axis(xs, where[c] + j, 1)  # (n, f) bytes
                g[f"w{w}"][j] = np.einsum("nfd,nf->df", self.p["e"][b], gw)
                np.add.at(g["e"], b, gw[:, :, None] * self.p[f"w{w}"][j].T[None])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 96, rate: float = 0.01, seed: int = 11) -> "ByteNetwork":
        """Adam on the cross-entropy."""
        rnd = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for t in range(1, steps + 1):
            rows = rnd.integers(0, len(x), min(batch, len(x)))
            g = self.gradients(x[rows], y[rows])
            lr = rate * (1 - t / (steps + 1))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self):
        """Look-ups by byte pair: (65536, 3 f) for bytes 0 and 1, (65536, 2 f) for bytes 2 and 3 of widths 3 and 4."""
        t = {w: np.einsum("bd,wdf->wbf", self.p["e"], self.p[f"w{w}"]).astype(np.float32) for w in WIDTHS}
        a, b = np.divmod(np.arange(65536), 256)
        first = np.concatenate([t[w][0][a] + t[w][1][b] + self.p[f"b{w}"].astype(np.float32) for w in WIDTHS], 1)
        then = np.concatenate([t[3][2][a], t[4][2][a] + t[4][3][b]], 1)
        return np.ascontiguousarray(first), np.ascontiguousarray(then)

    def log_probabilities(self, x: np.ndarray, tables=None, rows: int = 64) -> np.ndarray:
        first, then = tables or self.tables()
        f, out = self.f, np.empty((len(x), len(self.labels)))
        for s in range(0, len(x), rows):
            w = x[s : s + rows].astype(np.uint16)
            pair = (w[:, :-1] << 8) | w[:, 1:]
            r = first.take(pair[:, :-2], 0)
            r[:, :, f:] += then.take(pair[:, 2:], 0)
            # the two last places are without bytes for the wider filters; as in fit, each width ends where it fits
            pooled = r.max(1)
            pooled[:, :f] = np.maximum(pooled[:, :f], first.take(pair[:, -2:], 0)[:, :, :f].max(1))
            last = first.take(pair[:, -2], 0)[:, f : 2 * f] + then.take(w[:, -1].astype(np.int64) << 8, 0)[:, :f]
            pooled[:, f : 2 * f] = np.maximum(pooled[:, f : 2 * f], last)
            z = np.maximum(pooled, 0) @ self.p["o"] + self.p["ob"]
            z -= z.max(1, keepdims=True)
            out[s : s + rows] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def predict(self, texts: list, tables=None, piece: int = 4 << 20) -> list[tuple[str, float]]:
        """(label, probability) of whole texts; und, 0.0 for null texts and texts without a letter.

        Texts of over ``piece`` bytes go a piece after another, at window borders: the result is the same.
        """
        data, offsets = utf8_bytes(texts)
        result = []
        for i, j in groups_of_bytes(np.diff(offsets), piece):
            total, weight = np.zeros((j - i, len(self.labels))), np.zeros(j - i)
            step = max(piece // self.window * self.window, self.window)
            for at in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), step if j - i == 1 else len(data) + 1):
                end = min(int(offsets[j]), at + step) if j - i == 1 else int(offsets[j])
                part = np.clip(offsets[i : j + 1], at, end) - at
                x, owner, size = windows_of(data[at:end], part, self.window)
                np.add.at(total, owner, self.log_probabilities(x, tables) * np.maximum(size, 1)[:, None])
                np.add.at(weight, owner, np.maximum(size, 1))
            total /= weight[:, None]
            q = np.exp(total - total.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            best = q.argmax(1)
            result += [(self.labels[b], float(p[b])) for b, p in zip(best, q)]
        return [r if t is not None and has_letter(t) else (UNKNOWN, 0.0) for t, r in zip(texts, result)]


def held_out(id_col: str = "doc_id"):
    return (F.crc32(col(id_col).cast("string").cast("binary")) % 4) == 2


def training_rows(df: DataFrame, per_label: int = 400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", pieces: int = 8, piece: int = 512) -> list:
    """A sample of labelled rows for fitting, about ``per_label`` of each label, by a hash of the id.

    Bounded by the parameters: labels times about per_label rows. A text of more than ``pieces * piece`` characters
    gives that many pieces, spread evenly from its first to its last character; a shorter one is taken whole. Only
    fitting uses it; held-out rows and null labels or texts are never in it.
    """
    own = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"), col(label_col).cast("string").alias("label")).where(F.col("label").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out("id"), F.lit(False)))
    counts = {r.label: r.n for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    u = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_003)) / 1_000_003.0
    apart = (F.length("text") - piece) / (pieces - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substr(F.col("text"), (F.floor(k * apart) + 1).cast("int"), F.lit(piece)))
    text = F.when(F.length("text") <= pieces * piece, F.col("text")).otherwise(F.array_join(spread, " "))
    rows = own.where(u < share[F.col("label")]).select("id", text.alias("text"), "label").collect()
    return sorted((r.id if r.id is not None else -1, r.text, r.label) for r in rows)


#: First and last letters of scripts, for texts in no learned language.
SCRIPTS = ((0x61, 0x7A), (0xE0, 0xF6), (0x100, 0x17F), (0x3B1, 0x3C9), (0x430, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x628, 0x63A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3042, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def junk(texts: list[str], seed: int = 13) -> list[str]:
    """The texts with every letter drawn anew: half of them from their own letters, all alike, half from one script that they don't use."""
    rnd = np.random.default_rng(seed)
    own = sorted({c for t in texts for c in t if c.isalpha()})
    seen = set(own)
    other = [[chr(c) for c in range(a, b + 1)] for a, b in SCRIPTS if not any(chr(c) in seen for c in range(a, b + 1))]
    out = []
    for n, t in enumerate(texts):
        letters = other[n // 2 % len(other)] if n % 2 and other else own
        drawn = iter(rnd.integers(0, len(letters), len(t)).tolist())
        out.append("".join(letters[next(drawn)] if c.isalpha() else c for c in t))
    return out


def fit(df: DataFrame, per_label: int = 400, window: int = 512, background: bool = False, **cols) -> ByteNetwork | None:
    """Train on ``training_rows``; None if there are no labelled rows (then every text is und).

    With ``background``, und is a label of its own, learned from ``junk`` of about ``per_label`` of these rows.
    """
    rows = [r for r in training_rows(df, per_label, **cols) if has_letter(r[1])]
    if not rows:
        return None
    if background:
        texts = [r[1] for r in rows]
        rows = rows + [(-1, t, UNKNOWN) for t in junk(texts[:: max(1, len(texts) // per_label)])]
    labels = sorted({r[2] for r in rows})
    data, offsets = utf8_bytes([r[1] for r in rows])
    x, owner, _ = windows_of(data, offsets, window)
    y = np.array([labels.index(r[2]) for r in rows])[owner]
    # as many of each label, so that rare languages count as much
    rnd = np.random.default_rng(3)
    most = max(np.bincount(y))
    pick = np.concatenate([rnd.choice(np.flatnonzero(y == k), most) for k in range(len(labels))])
    return ByteNetwork(labels, window).fit(x[pick], y[pick])


def identify(df: DataFrame, model: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, and the columns of ``keep``.

    Null and empty texts and texts without a letter are ``und`` with score 0, as is everything without a model.
    Windows cover whole texts of any length; rows are independent, repeated ones get equal answers, nothing is
    shuffled, and an empty table gives an empty table. A label's ties go to the alphabetically first. Null ids aren't
    held out. A column c of ``keep`` comes back as ``_keep_c``; on the way they are packed in one, so no name can clash.
    """
    keep = keep or []
    src = df.select(col(id_col).cast("long").alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), col(text_col).cast("string").alias("text"), *([boxed(df, keep).alias("box")] if keep else []))
    schema = StructType.fromDDL("id long, held_out boolean, lang_pred string, score double")
    if keep:
        schema = schema.add(src.schema["box"])

    def run(batches):
        tables = model.tables() if model else None
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            got = model.predict(texts, tables) if model else [(UNKNOWN, 0.0)] * len(texts)
            cols = [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*cols, *([batch.column(3)] if keep else [])], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", *[F.col(f"box.c{i}").alias(f"_keep_{c}") for i, c in enumerate(keep)])


def accepted(df: DataFrame, model: ByteNetwork | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is identified with a probability of at least ``least``.

    Null and empty texts and texts without a letter go; without a model (no labelled rows) every text with a letter
    stays. Whole texts of any length are read; repeated rows fare alike; an empty table stays empty. Columns are packed in one on the
    way, so names with dots or of any inner column do no harm.
    """
    others = [c for c in df.columns if c != text_col]
    box = df.select(col(text_col).cast("string").alias("text"), boxed(df, others).alias("box"))
    places = {c: F.col(f"box.c{i}") for i, c in enumerate(others)} | {text_col: F.col("text").cast(df.schema[text_col].dataType)}

    def run(batches):
        tables = model.tables() if model else None
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            got = model.predict(texts, tables) if model else [(None, 1.0) if t is not None and has_letter(t) else (UNKNOWN, 0.0) for t in texts]
            yield batch.filter(pa.array([g[0] != UNKNOWN and g[1] >= least for g in got], pa.bool_()))

    return box.mapInArrow(run, box.schema).select(*[places[c].alias(c) for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return identify(documents, fit(documents))
