"""Near-duplicate documents by MinHash with odd sketches (operator 7).

A document is the set of its distinct five-word shingles. 128 MinHash samples give 32 bands of four for the
candidate search, and are folded into an odd sketch: a bitmap in which every (sample number, value) flips
one bit. The population count of two sketches' XOR estimates the similarity of high-similarity
pairs precisely; pairs that it can't rule out (six standard deviations) are verified on the full sets.

Equal sets are one class, represented by the smallest id. Within a band's bucket all members are tried
against the bucket's smallest member, which joins copies in numbers that follow the members and not
their pairs. Only buckets whose members still lie in different components are then tried pair by pair, in
blocks, and only across components: that can't lose a link that matters to a component.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, groups_of_bytes, load, slices
from .components import connected, roots

SAMPLES, ROWS, BITS, WORDS = 128, 4, 512, 5
BANDS = SAMPLES // ROWS
_rnd = np.random.default_rng(20240607)
_Q = _rnd.integers(0, 2**63, (WORDS, 2), np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_rnd.integers(0, 2**31, SAMPLES, np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rnd.integers(0, 2**32, SAMPLES, np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Digests(dict):
    """128-bit digests of words; short words are kept, up to ``cap`` of them."""

    cap, longest = 150_000, 64

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= self.longest:
            if len(self) >= self.cap:
                self.clear()
            self[word] = digest
        return digest


_DIGESTS = _Digests()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) digests of all words (A-Z lower-cased), and the offsets (len + 1) of each text's words."""
    words = [t.lower().split() for t in texts]  # of bytes: A-Z alone, and blanks and 0x09-0x0D
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    raw = b"".join(map(_DIGESTS.__getitem__, chain.from_iterable(words)))
    return np.frombuffer(raw, np.uint64).reshape(-1, 2), offsets


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def long_word_hashes(raw: bytes, most: int) -> np.ndarray:
    """word_hashes of one long text, about ``most`` bytes at a time; pieces end at a blank."""
    out, at = [np.zeros((0, 2), np.uint64)], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + most)
        end = gap.start() if gap else len(raw)
        out.append(word_hashes([raw[at:end]])[0])
        at = end
    return np.concatenate(out)


def _shingles(h: np.ndarray, half: int) -> np.ndarray:
    n = max(0, len(h) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for k in range(WORDS):
        s += h[k : k + n, half] * _Q[k, half]
    return mix(s)


def shingle_sets(texts: list[str | None], piece: int = 1 << 22, wide: bool = False) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with ``wide``, (n, 2) of them: the hash and 64 bits more."""
    out: list[np.ndarray] = []
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    halves = (0, 1) if wide else (0,)
    for i, j in groups_of_bytes(np.array([len(r) for r in raw], np.int64), 1 << 18):
        if len(raw[i]) > piece:  # a group of its own
            h = long_word_hashes(raw[i], piece)
            offsets = np.array([0, len(h)])
        else:
            h, offsets = word_hashes(raw[i:j])
        s = [_shingles(h, k) for k in halves]
        for a, b in zip(offsets[:-1], offsets[1:]):
            if b - a >= WORDS:
                own = [x[a : b - WORDS + 1] for x in s]
            elif b > a:  # one shingle, told apart from longer ones by its number of words
                own = [mix(np.array([(h[a:b, k] * _Q[: b - a, k]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)) for k in halves]
            else:
                own = [np.zeros(0, np.uint64) for _ in halves]
            if wide:
                first, at = np.unique(own[0], return_index=True)
                out.append(np.stack([first, own[1][at]], 1))
            else:
                out.append(np.unique(own[0]))
    return out


def samples(s: np.ndarray, block: int = 2048) -> np.ndarray:
    """MinHash samples of a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), block):
        np.minimum(low, (x[i : i + block, None] * _A + _B).min(0), out=low)
    return low


def bands(m: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys, each with its band's number in it."""
    x = np.zeros((len(m), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + m[:, k::ROWS].astype(np.uint64))
    return x.view(np.int64)


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """(n, BITS / 8) bytes: bit p is the parity of the samples that fall on p."""
    at = mix(m.astype(np.uint64) << np.uint64(8) | np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    flat = at.astype(np.int64) + np.arange(len(m))[:, None] * BITS
    odd = np.bincount(flat.ravel(), minlength=len(m) * BITS).reshape(len(m), BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def estimate(popcount: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    left = np.maximum(1 - 2 * popcount / BITS, 1e-9)
    return 1 + BITS / 2 * np.log(left) / (2 * SAMPLES)


def most_bits(similarity: float) -> int:
    """The largest population count that doesn't rule the similarity out, by six standard deviations."""
    least = max(0.0, similarity - 6 * (similarity * (1 - similarity) / SAMPLES) ** 0.5 - 0.02)
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - least) / BITS)))


def profile(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, id, n_shingles, key (digest of the set, null if empty), bands, sketch of every row."""
    schema = "rid long, id long, n_shingles long, key binary, bands array<long>, sketch binary"

    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column(2).to_pylist())
            m = np.stack([samples(s) for s in sets]) if sets else np.zeros((0, SAMPLES), np.uint32)
            full = np.array([len(s) > 0 for s in sets], bool)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            cols = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())]
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands(m[full]).ravel())))
            cols.append(pa.array([o.tobytes() for o in odd_sketches(m)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "id", "n_shingles", "key", "bands", "sketch"])

    return df.select(F.monotonically_increasing_id().alias("rid"), col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _popcounts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(-1)


def _sketch_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def sketched(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that the odd sketches don't rule out."""
    most = most_bits(similarity)
    own = reps.select("rep", "sketch")

    def run(batches):
        for batch in batches:
            ok = _popcounts(_sketch_matrix(batch.column(2)), _sketch_matrix(batch.column(3))) <= most if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    both = pairs.join(own.withColumnsRenamed({"rep": "a", "sketch": "sa"}), "a").join(own.withColumnsRenamed({"rep": "b", "sketch": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the sorted 128-bit shingle hashes, as bytes, of the documents whose ids are listed."""

    def pack(batches):  # texts make up most of what is shuffled here
        for batch in slices(batches):
            z = [zstandard.compress((t or "").encode("utf-8", "surrogatepass"), 3) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["id", "z"])

    def run(batches):
        for batch in slices(batches):
            got = shingle_sets([zstandard.decompress(z).decode("utf-8", "surrogatepass") for z in batch.column(1).to_pylist()], wide=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.T.tobytes() for s in got], pa.binary())], names=["id", "s"])

    texts = df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(pack, "id long, z binary")
    return texts.join(ids.select("id").distinct(), "id").select("id", "z").mapInArrow(run, "id long, s binary")


def _wide(s: bytes) -> np.ndarray:
    """(n, 2) from the bytes of ``full_sets``, which hold all first halves, then all second ones."""
    return np.frombuffer(s, np.uint64).reshape(2, -1).T


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sets of 128-bit hashes, sorted by their first halves."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x[:, 0], y[:, 0]])
    both.sort()
    most = int(np.count_nonzero(both[1:] == both[:-1]))  # the second halves can only make it less
    if 100 * most < percent * (len(x) + len(y) - most):
        return False
    _, i, j = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    inter = int(np.count_nonzero(x[i, 1] == y[j, 1]))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def verified(pairs: DataFrame, df: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union, exactly."""
    own = full_sets(df, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), id_col, text_col)

    def run(batches):
        for part in slices(batches):
            ok = pa.array([similar(_wide(x.as_py()), _wide(y.as_py()), percent) for x, y in zip(part.column(2), part.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    both = pairs.join(own.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(own.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def families(rows: DataFrame, similarity: float, block: int = 256) -> DataFrame:
    """(node, component) of the graph of all pairs of a bucket that lie in different components and pass the sketches.

    Rows are (h, rep, component, size, sketch). Buckets are dealt as pairs of blocks, and a task returns a spanning
    star of what it found, so the rows returned follow the members and not their pairs.
    """
    most = most_bits(similarity)
    own = rows.withColumn("n", F.ceil(F.col("size") / block).cast("int")).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("h", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "rep", "component", "sketch")

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        k, rep, comp = (table.column(c).to_numpy() for c in ("k", "rep", "component"))
        s = _sketch_matrix(table.column("sketch"))
        left, right = np.flatnonzero(k == i), np.flatnonzero(k == j)
        a, b = [], []
        for x in left:
            y = right[comp[right] != comp[x]]
            y = y[_popcounts(s[y], s[x][None]) <= most]
            a.append(np.full(len(y), rep[x]))
            b.append(rep[y])
        nodes, root = roots(np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)]))
        return pa.table({"a": nodes[nodes != root], "b": root[nodes != root]})

    return connected(dealt.groupBy("h", "i", "j").applyInArrow(run, "a long, b long"))


def within_families(rows: DataFrame, sizes: DataFrame, percent: int, similarity: float, block: int = 256, block_shingles: int = 1 << 20) -> DataFrame:
    """Links (a, b) between components, by the full sets, of rows (family, rep, component, sketch, s).

    ``sizes`` has family, component and n_shingles of the same rows, without their sets. The largest component of a
    family is compared with the other members only, and these with each other, in pairs of blocks of about ``block``
    members and ``block_shingles`` shingles (16 bytes each). Within a task the likeliest pairs come first, and pairs that links found so far have
    joined already are left out, so what a task returns joins the same components as all its links would.
    """
    most = most_bits(similarity)
    counts = sizes.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    sizes = counts.groupBy("family").agg(F.max(F.struct("n", "component", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(w / block_shingles)).cast("int")
    sizes = sizes.select("family", F.pmod("family", F.lit(97)).alias("t"), F.col("m.component").alias("main"), blocks(F.col("m.n"), F.col("m.w")).alias("mains"), blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("others"))
    own = rows.withColumn("t", F.pmod("family", F.lit(97))).join(sizes, ["family", "t"]).withColumn("is_main", F.col("component") == F.col("main"))
    own = own.withColumn("k", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    of_main = each(F.col("others"), lambda o: task(0, F.col("k"), o))
    of_other = F.concat(each(F.col("mains"), lambda m: task(0, m, F.col("k"))), each(F.col("others"), lambda o: task(1, F.least("k", o), F.greatest("k", o))))
    dealt = own.withColumn("task", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other))).select("family", "task.*", "is_main", "k", "rep", "component", "sketch", "s")

    def run(table: pa.Table) -> pa.Table:
        kind, i, j = (table.column(c)[0].as_py() for c in ("kind", "i", "j"))
        main, k, rep, comp = (table.column(c).to_numpy() for c in ("is_main", "k", "rep", "component"))
        bits, sets = _sketch_matrix(table.column("sketch")), [_wide(x.as_py()) for x in table.column("s")]
        left, right = (np.flatnonzero(main), np.flatnonzero(~main)) if kind == 0 else (np.flatnonzero(k == i), np.flatnonzero(k == j))
        low = {c: c for c in comp.tolist()}

        def top(c):
            while low[c] != c:
                low[c] = c = low[low[c]]
            return c

        found = []
        for x in left:
            y = right[comp[right] != comp[x]]
            d = _popcounts(bits[y], bits[x][None]).astype(np.int64)
            found.append(np.stack([d[d <= most], np.full(int((d <= most).sum()), x), y[d <= most]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        a, b = [], []
        for _, x, y in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
            p, q = top(int(comp[x])), top(int(comp[y]))
            if p != q and similar(sets[x], sets[y], percent):
                low[p] = q
                a.append(rep[x])
                b.append(rep[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("family", "kind", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """id, n_shingles, component_id, kept of every row.

    Words are runs of bytes other than blanks and 0x09-0x0D, with A-Z lower-cased, and enter by 128-bit digests; links are
    confirmed on all shingles, by 128 bits each. Texts of fewer words are one shingle; texts without words (null and
    empty ones too) are linked with nothing. component_id is the smallest id reachable over links of
    100 * intersection >= percent * union (a pair exactly at the bound links); kept marks the row whose id that is. Rows
    that share an id count as one document; rows with a null id link with nothing, have a null component and
    aren't kept. Very long texts are hashed piece by piece, ended at blanks. Other columns are ignored, whatever their
    names; an empty table gives an empty table. A pair at the threshold shares none of the 32 bands with a probability of
    5e-6, less above it.
    """
    similarity = percent / 100
    own = cut(profile(df, id_col, text_col))
    linked = own.where("key is not null and id is not null")
    # n_shingles follows from key: as a second join key it lets Spark deal (and split) both sides anew
    reps = cut(linked.groupBy("key").agg(F.min(F.struct("id", "rid", "n_shingles")).alias("m")).select("key", F.col("m.id").alias("rep"), "m.rid", "m.n_shingles"))
    full = cut(linked.select("rid", "bands", "sketch").join(reps.select("rid", "rep", "n_shingles"), "rid").select("rep", "n_shingles", "bands", "sketch"))
    rows = full.select("rep", F.explode("bands").alias("h"))
    rows = rows.withColumn("t", F.pmod("h", F.lit(97)))
    buckets = rows.groupBy("h").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("t", F.pmod("h", F.lit(97)))
    filed = cut(rows.join(buckets, ["h", "t"]).select("h", "rep", "pivot", "size"))
    stars = filed.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    close = cut(sketched(stars, full, similarity))
    links = cut(verified(close, df, percent, id_col, text_col))
    first = cut(connected(links))

    several = filed.where("size > 2").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).withColumn("t", F.pmod("h", F.lit(97)))
    mixed = several.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("h", F.pmod("h", F.lit(97)).alias("t"))
    rest = several.join(mixed, ["h", "t"]).join(full.select("rep", "sketch"), "rep").select("h", "rep", "component", "size", "sketch")
    family = cut(families(rest, similarity)).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = family.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = cut(members.join(full.select("rep", "n_shingles", "sketch"), "rep"))
    sets = full_sets(df, family.select(F.col("rep").alias("id")), id_col, text_col).withColumnRenamed("id", "rep")
    late = cut(within_families(members.drop("n_shingles").join(sets, "rep"), members.select("family", "component", "n_shingles"), percent, similarity))
    second = connected(_lifted(late, first))
    top = second.select(F.col("node").alias("component"), F.col("component").alias("top"))
    component = first.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    component = component.unionByName(second.join(first, "node", "left_anti")).withColumnRenamed("node", "rep")

    ranked = reps.select("key", "n_shingles", "rep").join(component, "rep", "left").select("key", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    joined = linked.select("id", "key", "n_shingles").join(ranked, ["key", "n_shingles"]).select("id", "n_shingles", "component_id")
    lone = own.where("key is null or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return joined.unionByName(lone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _lifted(links: DataFrame, component: DataFrame) -> DataFrame:
    """Links between the components of their ends."""
    for c in ("a", "b"):
        links = links.join(component.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    return links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
