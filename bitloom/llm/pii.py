"""Personal data by weak supervision (operator 5).

Candidate spans come from patterns. Labelers of three sorts vote on each (+1, 0, -1): format checks, gazetteers
and words of the context. Votes are counted by pattern over the whole corpus; expectation-maximisation
estimates how reliable each labeler is and how probable each pattern is to be personal data. A logistic
classifier learns these probabilities from what the labelers don't see: the span's own words and shape and the words and
characters around it. The base kinds (email, ip, card, phone) are always
reported as their definitions say; the classifier decides which spans of the other kinds are added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, load, slices

KINDS = ("email", "ip", "card", "phone", "address", "local", "name", "number")
BASE = 4

# Word lists of the labelers.
CONTEXT = (
    ("mail", "contact", "write", "reach", "correo", "courriel", "adresse", "schreib", "escrib"),
    ("ip", "host", "server", "address", "login", "adresse", "from", "client", "connect"),
    ("card", "visa", "mastercard", "credit", "payment", "karte", "tarjeta", "carte", "amex", "pay", "zahl", "pago"),
    ("phone", "call", "tel", "mobile", "fax", "telefon", "cell", "anruf", "llam", "appel", "handy", "whatsapp"),
    ("mail", "contact", "write", "reach", "correo", "courriel", "schreib", "escrib"),
    ("phone", "call", "tel", "mobile", "fax", "cell", "dial", "ring", "whatsapp"),
    ("name", "contact", "dear", "sincerely", "regards", "herr", "frau", "signed", "author", "by", "met", "said"),
    ("ssn", "social", "passport", "license", "id", "security", "taxpayer", "number"),
)
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Rev", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Sra", "Sr", "Srta", "Señor", "Señora", "Signor", "Signora", "Don", "Doña")
GIVEN = (
    "Adam", "Adrian", "Alan", "Albert", "Alejandro", "Alex", "Alexander", "Alice", "Amanda", "Amelia", "Ana", "Andrea", "Andrew", "Angela", "Anna", "Anne", "Anthony", "Antonio", "Arthur", "Barbara",
    "Ben", "Benjamin", "Bernd", "Brian", "Camille", "Carlos", "Carmen", "Caroline", "Charles", "Charlotte", "Chloé", "Christian", "Christine", "Claire", "Claudia", "Daniel", "David", "Deborah", "Diego", "Dieter",
    "Donald", "Dorothy", "Edward", "Elena", "Elizabeth", "Emily", "Emma", "Eric", "Eva", "Felix", "Fernando", "Florian", "François", "Frank", "Friedrich", "Gabriel", "George", "Grace", "Hannah", "Hans",
    "Heinrich", "Helen", "Henry", "Hugo", "Ines", "Isabel", "Jack", "Jacob", "James", "Jan", "Jane", "Javier", "Jean", "Jennifer", "Jessica", "Joan", "Johann", "John", "Jonas", "Jose",
    "José", "Joseph", "Juan", "Julia", "Julie", "Jürgen", "Karen", "Karin", "Karl", "Katharina", "Kevin", "Klaus", "Laura", "Léa", "Leon", "Linda", "Lisa", "Louis", "Luca", "Lucas",
    "Lucia", "Luis", "Lukas", "Manuel", "Marco", "Margaret", "Maria", "María", "Marie", "Mark", "Markus", "Martin", "Mary", "Matthew", "Matthias", "Max", "Mia", "Michael", "Michel", "Miguel",
    "Monika", "Nancy", "Nicolas", "Nina", "Olivia", "Oscar", "Pablo", "Patricia", "Paul", "Pedro", "Peter", "Philip", "Pierre", "Rachel", "Ralf", "Richard", "Robert", "Rosa", "Ruth", "Ryan",
    "Sabine", "Samuel", "Sandra", "Sarah", "Sebastian", "Sofia", "Sophia", "Sophie", "Stefan", "Stephen", "Steven", "Susan", "Theresa", "Thomas", "Tim", "Tobias", "Ursula", "Victor", "Werner", "William", "Wolfgang", "Yves",
)
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
COUNTRY = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420")
ISSUER = ("4", "5", "34", "37", "6011", "35", "36", "30", "38", "65", "2")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_HIDDEN = re.compile(r"[\[(]at[\])]")
_BEHIND = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63})+")  # labels have 63 characters at most, local parts 64
_NAME = re.compile(r"(?<![^\W_])(?:(?:" + "|".join(TITLES) + r")\.? ([A-Z][a-zà-ÿ]{2,})|(" + "|".join(GIVEN) + r") [A-Z][a-zà-ÿ]{2,})")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += (2 * n - 9 if n > 4 else 2 * n) if i & 1 else n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches: what precedes an @ is taken back to the last @ or match at most."""
    low, at = 0, text.find("@")
    while at >= 0:
        head = text[low:at]
        size = len(head) - len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if size else None
        if m:
            yield at - size, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def _before(text: str, start: int, reach: int = 24) -> str:
    return text[max(0, start - reach) : start].lower()


def _context(text: str, start: int, kind: int) -> int:
    words = re.findall(r"[a-zà-ÿ]+", _before(text, start))
    return 1 if any(w.startswith(c) for w in words for c in CONTEXT[kind]) else 0


def _edges(text: str, start: int, end: int) -> int:
    """-1 where a letter or digit touches the span, +1 where both sides are blank or punctuation."""
    near = text[max(0, start - 1) : start] + text[end : end + 1]
    return -1 if any(c.isalnum() for c in near) else 1


def candidates(text: str) -> list[tuple[int, int, int, tuple[int, int, int, int]]]:
    """(kind, start, end, votes of format, gazetteer, context, edges), by kind and start."""
    out = []

    def add(kind, start, end, good, known):
        out.append((kind, start, end, (good, known, _context(text, start, kind), _edges(text, start, end))))

    if "@" in text:
        for s, e in _emails(text):
            add(0, s, e, 1, 1 if text[s:e].rpartition(".")[2].lower() in TOP_LEVEL else 0)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = m.group().split(".")
            ok = all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts)
            add(1, m.start(), m.end(), 1 if ok else -1, -1 if parts[0] in ("0", "127", "255") else 0)
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19:
                    add(2, m.start(), m.end(), 1 if luhn(d) else -1, 1 if d.startswith(ISSUER) else -1)
        if "+" in text:
            for m in _PHONE.finditer(text):
                d = re.sub(r"[^0-9]", "", m.group())
                add(3, m.start(), m.end(), 1 if 9 <= len(d) <= 15 else -1, 1 if d.startswith(COUNTRY) else -1)
    if "at]" in text or "at)" in text:
        for m in _HIDDEN.finditer(text):
            a = re.search(r"[A-Za-z0-9._%+-]{1,64} ?$", text[max(0, m.start() - 65) : m.start()])
            b = _BEHIND.match(text, m.end())
            if a and b:
                s, e = m.start() - len(a.group()), b.end()
                add(4, s, e, 1, 1 if re.split(r"[ .\])]", text[s:e])[-1].lower() in TOP_LEVEL else 0)
    if "-" in text:
        for m in _LOCAL_PHONE.finditer(text):
            add(5, m.start(), m.end(), 1 if m.group().lstrip("(")[0] in "23456789" else -1, 0)
    for m in _NAME.finditer(text):
        add(6, m.start(), m.end(), 1 if m.group(1) else 0, 1 if m.group(2) or m.group(1) in GIVEN else 0)
    if "-" in text:
        for m in _NUMBER.finditer(text):
            add(7, m.start(), m.end(), -1 if m.group()[:3] in ("000", "666") else 1, 0)
    return sorted(out)


def _kind_of_char(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


BUCKETS = 61
_WORD = re.compile(r"[^\W\d_]+")
_PLACES = ("kind", "size", "first", "last", "before", "before that", "behind", "left", "right", "digits", "line")


def features(text: str, c) -> list[int]:
    """Numbers of the binary features of a span: its kind, and by kind its length, words and shape and what stands around it."""
    kind, s, e, _ = c
    span, before, behind = text[s:e], _WORD.findall(text[max(0, s - 40) : s].lower()), _WORD.search(text, e, e + 40)
    words = _WORD.findall(span.lower())
    digits = [x for x in span if "0" <= x <= "9"]
    of = lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
    values = (
        0,
        min(9, (e - s) // 4),
        of(words[0] if words else digits[0] if digits else ""),
        of(words[-1] if words else ""),
        of(before[-1] if before else ""),
        of(before[-2] if len(before) > 1 else ""),
        of(behind.group().lower() if behind else ""),
        _kind_of_char(text[s - 1 : s]),
        _kind_of_char(text[e : e + 1]),
        min(5, len(set(digits))) * 2 + (len(digits) > 9),
        int(s == 0 or text[s - 1] == "\n"),
    )
    return [(kind * len(_PLACES) + place) * BUCKETS + v for place, v in enumerate(values)]


def valid(c) -> bool:
    """Base candidates whose format check held; others are only candidates."""
    return c[0] < BASE and c[3][0] > 0


def pattern_of(c) -> int:
    """Kind, length class and votes as one number (below 8 * 4 * 81)."""
    code = c[0] * 4 + min(3, (c[2] - c[1]) // 10)
    for v in c[3]:
        code = code * 3 + v + 1
    return code


def _decoded(code: int) -> tuple[int, int, tuple]:
    votes = []
    for _ in range(4):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return (*divmod(code, 4), tuple(votes[::-1]))


class SpanModel:
    """Labeler reliabilities by expectation-maximisation, and the classifier trained on its posteriors.

    ``counts`` are of vote patterns; ``spans`` are (pattern, features) of the spans that the classifier learns from.
    """

    def __init__(self, counts: dict[int, int], spans: list[tuple[int, list[int]]] = (), rounds: int = 60, steps: int = 300):
        codes = sorted(counts)
        self.posterior: dict[int, float] = {}
        self.reliability = np.full((4, 2, 3), 1 / 3)
        self.weights = np.zeros(len(KINDS) * len(_PLACES) * BUCKETS)
        if not codes:
            return
        parts = [_decoded(c) for c in codes]
        kind, votes = np.array([p[0] for p in parts]), np.array([p[2] for p in parts])
        n = np.array([counts[c] for c in codes], float)
        post = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
        for _ in range(rounds):
            table = np.ones((4, 2, 3))  # add-one smoothing
            prior = np.full((len(KINDS), 2), 1.0)
            for j in range(4):
                np.add.at(table[j, 1], votes[:, j] + 1, n * post)
                np.add.at(table[j, 0], votes[:, j] + 1, n * (1 - post))
            np.add.at(prior[:, 1], kind, n * post)
            np.add.at(prior[:, 0], kind, n * (1 - post))
            voted = table[:, :, ::2].sum(2, keepdims=True)  # to abstain tells nothing
            z = np.log(prior[kind, 1] / prior[kind, 0])
            for j in range(4):
                of = table[j, :, :] / voted[j]
                z += np.where(votes[:, j] != 0, np.log(of[1, votes[:, j] + 1] / of[0, votes[:, j] + 1]), 0)
            table /= table.sum(2, keepdims=True)
            post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        self.reliability, self.posterior = table, dict(zip(codes, post.tolist()))
        self._learn([s for s in spans if s[0] in self.posterior], steps)

    def _learn(self, spans: list, steps: int, rate: float = 0.5) -> None:
        """Logistic regression on the posteriors, by Adagrad; every kind weighs as much, whatever its number of spans."""
        if not spans:
            return
        x, y = np.array([f for _, f in spans]), np.array([self.posterior[c] for c, _ in spans])
        kind = x[:, 0] // (len(_PLACES) * BUCKETS)
        share = 1 / np.bincount(kind, minlength=len(KINDS))[kind]
        w, seen = self.weights, np.zeros_like(self.weights)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
            g = np.bincount(x.ravel(), np.repeat(share * (p - y), x.shape[1]), len(w)) + 1e-4 * w
            seen += g * g
            w -= rate * g / (np.sqrt(seen) + 1e-9)

    def probability(self, text: str, c) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features(text, c)].sum(), -30, 30))))

    def accepts(self, text: str, c) -> bool:
        """More probable than not; kinds that never occurred have no weights and aren't accepted."""
        return self.probability(text, c) > 0.5


def fit(df: DataFrame, text_col: str = "text", fit_spans: int = 2000) -> SpanModel:
    """Count vote patterns over all texts (at most 8 * 4 * 81 of them reach the driver) and train.

    The classifier learns from at most ``fit_spans`` spans of each kind, those of the smallest hashes of the span and what
    stands around it, so copies count once and the choice doesn't depend on how rows are dealt out.
    """

    def run(batches):
        seen: Counter = Counter()
        chosen: list[dict] = [{} for _ in KINDS]
        for batch in slices(batches):
            for t in batch.column(0):
                if text := t.as_py():
                    for c in candidates(text):
                        code = pattern_of(c)
                        seen[code] += 1
                        near = text[max(0, c[1] - 24) : c[2] + 24].encode("utf-8", "surrogatepass")
                        chosen[c[0]].setdefault(int.from_bytes(hashlib.blake2b(near, digest_size=7).digest(), "big"), (code, features(text, c)))
                for k, own in enumerate(chosen):
                    if len(own) > 2 * fit_spans:
                        chosen[k] = {h: own[h] for h in sorted(own)[:fit_spans]}
        rows = [(-1, code, n, []) for code, n in seen.items()] + [(h, code, k, f) for k, own in enumerate(chosen) for h in sorted(own)[:fit_spans] for code, f in [own[h]]]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int32()))], names=["h", "code", "n", "f"])

    met = cut(df.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "h long, code long, n long, f array<int>"))
    counts = met.where("h = -1").groupBy("code").agg(F.sum("n").alias("n")).collect()
    distinct = met.where("h >= 0").groupBy(F.col("n").alias("kind"), "h").agg(F.min(F.struct("code", "f")).alias("s"))
    first = F.row_number().over(Window.partitionBy("kind").orderBy("h"))
    spans = distinct.withColumn("place", first).where(F.col("place") <= fit_spans).select("kind", "h", "s.*").collect()
    return SpanModel({r.code: r.n for r in counts}, [(r.code, r.f) for r in sorted(spans, key=lambda r: (r.kind, r.h))])


def find(df: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_base, n_private.

    ``spans`` holds kind:start:end by kind, then start, in code points, end exclusive: all base spans and those that the
    classifier adds; ``base_sha256`` digests the base ones alone. ``n_base`` counts the base spans, ``n_private`` all. Null and empty
    texts have no spans; texts of any length are read whole; rows are independent, repeated ones get equal answers; of
    equal kinds and starts none occurs twice; extra columns are ignored, whatever their names; an empty table gives an
    empty table; nothing is shuffled.
    """
    names = ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_base", "n_private"]

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py() or ""
                all_spans = candidates(text)
                base = [c for c in all_spans if valid(c)]
                added = [c for c in all_spans if c[0] >= BASE and model.accepts(text, c)]
                write = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in xs)
                n = Counter(c[0] for c in base)
                rows.append((doc, *(n[k] for k in range(BASE)), hashlib.sha256(write(base).encode()).hexdigest(), write(base + added), len(added), len(base), len(base) + len(added)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 10, kinds)], names=names)

    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_base long, n_private long"
    return df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return find(documents, fit(documents))
