"""Exact removal of repeated byte strings by suffix sorting (operator 8).

A string of ``length`` bytes is anchored at its smallest k-gram (by a hash; ties to the left), so equal strings
have equal anchors. Consecutive strings with one anchor are a run, and a document is a few runs per hundred
bytes. Runs are dealt by their anchor's hash. Runs that are equal as a whole collapse to the earliest, the
others being repeated for sure; anchors that occur once drop out; what is left, different runs around one anchor, fetches
its bytes and is suffix sorted in two stages: suffixes smaller than their successors are sorted directly, the rest
is induced from them by bucket scans. Adjacent common prefixes of at least ``length`` bytes then tell which strings
are equal, and all but the earliest are repeated. Runs around anchors that very many documents share are dealt
string by string instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import boxed, col, give_back, groups_of_bytes, load, slices, stored, utf8_bytes
from .minhash import mix

GRAM = 32
_rnd = np.random.default_rng(20240607)
_BYTE = _rnd.integers(0, 2**64, (2, 256), np.uint64)
_BASE = (0x9E3779B97F4A7C13, 0xD1342543DE82EF95)  # odd
_LAST = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFF)


_POWERS: dict[int, tuple] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[base] = tuple(both)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def runs(data: np.ndarray, offsets: np.ndarray, length: int = 100):
    """Runs of strings with one anchor: text, first start in it, number of strings, anchor hash, content hash."""
    return hashed_runs(data, offsets, length)[:5]


def hashed_runs(data: np.ndarray, offsets: np.ndarray, length: int = 100):
    """runs() with a second, independent content hash behind the first.

    Works on at most 2**24 bytes: the position is the low part of the keys whose minimum slides over the text.
    """
    none = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)]
    n, window = len(data), length - GRAM + 1
    if n < length:
        return none
    assert n <= int(_LOW)
    totals, downs = [], []
    for table, number in zip(_BYTE, _BASE):
        up, down = _powers(n + 1, number)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:-1], out=total[1:])
        totals.append(total)
        downs.append(down)
    h = mix((totals[0][GRAM:] - totals[0][:-GRAM]) * downs[0][: n - GRAM + 1])
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < window:
        step = min(size, window - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(ends[: len(low)] - np.arange(len(low)) >= length)
    if not len(at):
        return none
    anchor = (low[at] & _LOW).astype(np.int64)
    new = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    first, last, anchor = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], anchor[new]
    text = np.searchsorted(offsets, first, "right") - 1
    shape = ((last - first).astype(np.uint64) << np.uint64(32)) | (anchor - first).astype(np.uint64)
    content = [mix((total[last + length] - total[first]) * down[first] + mix(shape)) for total, down in zip(totals, downs)]
    return text, first - offsets[text], last - first + 1, h[anchor], *content


def _anchored(df: DataFrame, length: int) -> DataFrame:
    """f, g, e, doc, rid, at, known: at packs a run's start and number of strings.

    Known runs repeat one of their own batch and need no partner; those that follow each other in a text are one row,
    with the number of its strings in g.
    """

    def run(batches):
        for batch in slices(batches, 1024):
            rid, doc = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = utf8_bytes(batch.column(2).to_pylist())
            found = []
            for i, j in groups_of_bytes(np.diff(offsets), 1 << 17):
                for s, part, o in _pieces(data, offsets, i, j, length):
                    text, start, n, f, g, e = hashed_runs(part, o, length)
                    found.append((rid[i + text], doc[i + text], ((start + s) << 8) | n, f, g, e))
            if not found:
                continue
            r, d, at, f, g, e = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((at, r, d, e, g, f))
            r, d, at, f, g, e = (x[order] for x in (r, d, at, f, g, e))
            known = np.zeros(len(r), bool)
            known[1:] = (f[1:] == f[:-1]) & (g[1:] == g[:-1]) & (e[1:] == e[:-1])
            if known.any():
                mine = np.flatnonzero(known)
                mine = mine[np.lexsort((at[mine], r[mine]))]
                start, n = at[mine] >> 8, at[mine] & 255
                new = np.flatnonzero(np.concatenate([[True], (r[mine][1:] != r[mine][:-1]) | (start[1:] != (start + n)[:-1])]))
                strings, mine = np.add.reduceat(n, new), mine[new]
                # dealt anywhere, so that a common passage makes no large group
                spread = mix(mix(r[mine].astype(np.uint64)) + at[mine].astype(np.uint64))
                own, zeros = ~known, np.zeros(len(mine), np.uint64)
                f, g, e = (np.concatenate([x[own], y]) for x, y in ((f, spread), (g, strings.astype(np.uint64)), (e, zeros)))
                r, d, at = (np.concatenate([x[own], x[mine]]) for x in (r, d, at))
                known = np.arange(len(r)) >= np.count_nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), pa.array(e.view(np.int64)), pa.array(d), pa.array(r), pa.array(at), pa.array(known)], names=["f", "g", "e", "doc", "rid", "at", "known"])

    return df.mapInArrow(run, "f long, g long, e long, doc long, rid long, at long, known boolean")


def _pieces(data: np.ndarray, offsets: np.ndarray, i: int, j: int, length: int, most: int = 1 << 20):
    """(start in the text, bytes, offsets) of texts i to j; a single very long text goes in pieces that overlap so that each string lies in one."""
    base, end = int(offsets[i]), int(offsets[j])
    if end - base <= most:
        yield 0, data[base:end], offsets[i : j + 1] - base
    else:  # groups_of_bytes gives such a text a group of its own
        for s in range(0, end - base - length + 1, most - length + 1):
            part = data[base + s : min(end, base + s + most)]
            yield s, part, np.array([0, len(part)], np.int64)


def _judge(batches, length: int):
    """Of rows sorted by f, g, e, doc, rid, at: runs that repeat an earlier equal one (ask false), and those to compare (ask true).

    What repeats needs its bytes only: at is where they start then, f where they end, and doc 0.
    """
    held, last = None, None  # held: the only run of its f so far; last: f, g and e of the row before
    for batch in batches:
        known = np.asarray(batch.column(6).to_numpy(zero_copy_only=False))
        cols = [np.asarray(batch.column(k)) for k in range(6)]
        again, n, out = [c[known] for c in cols], cols[1][known], [c[:0] for c in cols]
        own = [c[~known] for c in cols]
        if len(own[0]):
            new = [np.ones(len(own[0]), bool) for _ in range(3)]
            for k in range(3):
                new[k][1:] = own[k][1:] != own[k][:-1]
                if last is not None:
                    new[k][0] = own[k][0] != last[k]
            fresh = new[0] | new[1] | new[2]
            reps = np.flatnonzero(fresh)
            head = new[0][reps]
            ask = ~head  # not the first of its f
            ask[:-1] |= head[:-1] & ~head[1:]
            again = [np.concatenate([x, y[~fresh]]) for x, y in zip(again, own)]
            n = np.concatenate([n, own[5][~fresh] & 255])
            out = [y[reps[ask]] for y in own]
            if held is not None and len(reps):
                if not head[0]:  # a second run of the held one's f
                    out = [np.concatenate([[x], y]) for x, y in zip(held, out)]
                held = None
            if len(reps) and head[-1]:
                held = tuple(int(x[reps[-1]]) for x in own)
            last = tuple(own[k][-1] for k in range(3))
        start = again[5] >> 8
        for ask_, found in ((False, (start + n + (length - 1), np.zeros(len(n)), again[4], start)), (True, (out[0], *out[3:]))):
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in found], pa.array(np.full(len(found[0]), ask_))], names=["f", "doc", "rid", "at", "ask"])


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number."""
    x = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = x[:-8] << np.uint64(56)
    for k in range(1, 8):
        out |= x[k : k - 8] << np.uint64(56 - 8 * k)
    return out


def _steps(length: int) -> list[int]:
    """Places of the eight-byte words that cover a string; the last may overlap the one before."""
    if length < 8:
        raise ValueError("strings of at least eight bytes")
    return [*range(0, length - 8, 8), length - 8]


def _direct(p: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Positions sorted by their first ``length`` bytes, word by word among those still equal."""
    top = len(words) - 1
    order = np.argsort(words[p], kind="stable")
    p = p[order]
    key = words[p]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(p) else np.zeros(0, np.int64)
    live = np.arange(len(p))
    for s in _steps(length)[1:]:
        many = np.zeros(len(live), bool)
        if len(live) > 1:
            same = group[1:] == group[:-1]
            many[1:] |= same
            many[:-1] |= same
        live, group = live[many], group[many]
        if not len(live):
            break
        key = words[np.minimum(p[live] + s, top)]
        order = np.lexsort((key, group))
        p[live], key, group = p[live][order], key[order], group[order]
        group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
    return p


def suffix_order(b: np.ndarray, first: np.ndarray, last: np.ndarray, ends: np.ndarray, length: int = 100) -> np.ndarray:
    """The positions first..last (inclusive) of all segments, ordered by their first ``length`` bytes.

    Segments don't overlap in b and end (exclusively) at ``ends`` = last + length. A position is direct if its
    suffix is smaller than its successor; of each segment the positions behind ``last`` up to the next direct one take part,
    as inducing needs no more than the bytes that are there. Ties at the full length are in any order.
    """
    n = len(b)
    words = _words(b)
    nxt = np.append(b[1:], np.uint8(0))
    # the next position that differs from its successor decides for a row of equal bytes
    differs = np.where(b != nxt, np.arange(n), n)
    differs = np.minimum.accumulate(differs[::-1])[::-1]
    decided = np.minimum(differs, n - 1)
    owner = np.repeat(np.arange(len(ends)), ends - first)
    base = np.concatenate([[0], ends[:-1]])
    assert (base == first).all() and (len(ends) == 0 or ends[-1] == n)
    end = ends[owner]
    direct = (b[decided] < nxt[decided]) | (decided >= end - 1)
    where = np.where(direct, np.arange(n), n)
    where = np.minimum.accumulate(where[::-1])[::-1]
    stop = np.minimum(where[last], ends - 1)
    inside = np.arange(n) <= stop[owner]
    direct[stop] = True
    induced = inside & ~direct
    sorted_ = _direct(np.flatnonzero(inside & direct), words, length)
    bounds = np.searchsorted(b[sorted_], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    parts: list[np.ndarray] = []

    def push(p: np.ndarray, c: int) -> np.ndarray:
        """Queue the induced predecessors by their first byte; those of this very bucket are returned."""
        p = p[p > 0] - 1
        p = p[induced[p]]
        if not len(p):
            return p
        ch = b[p]
        order = np.argsort(ch, kind="stable")
        p, ch = p[order], ch[order]
        cuts = np.flatnonzero(np.diff(ch)) + 1
        same = p[:0]
        for x in np.split(p, cuts):
            if b[x[0]] == c:
                same = x
            else:
                queues[b[x[0]]].append(x)
        return same

    for c in range(256):
        cur = np.concatenate(queues[c]) if queues[c] else sorted_[:0]
        queues[c] = []
        while len(cur):
            parts.append(cur)
            cur = push(cur, c)
        own = sorted_[bounds[c] : bounds[c + 1]]
        if len(own):
            parts.append(own)
            push(own, c)
    order = np.concatenate(parts) if parts else sorted_
    return order[order <= last[owner[order]]]


def common_prefixes(b: np.ndarray, order: np.ndarray, length: int = 100) -> np.ndarray:
    """Equal bytes of each adjacent pair of an order, up to ``length``."""
    words = _words(b)
    out = np.full(max(0, len(order) - 1), length, np.int64)
    live = np.arange(len(out))
    for s in _steps(length):
        x = words[order[live] + s] ^ words[order[live + 1] + s]
        off = np.flatnonzero(x)
        if len(off):
            high = np.zeros(len(off), np.int64)
            y = x[off]
            for bit in (32, 16, 8):  # the byte of the highest set bit
                big = (y >> np.uint64(bit)) > 0
                high += np.where(big, bit // 8, 0)
                y = np.where(big, y >> np.uint64(bit), y)
            out[live[off]] = s + 7 - high
            live = live[x == 0]
    return out


def repeated(segments: list[bytes], rank: np.ndarray, length: int = 100) -> list[np.ndarray]:
    """For each segment, which of its strings also start earlier: in a segment of a lower rank or before it in the same."""
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(sizes)
    first, last = ends - sizes, ends - length
    b = np.frombuffer(b"".join(segments), np.uint8)
    order = suffix_order(b, first, last, ends, length)
    group = np.cumsum(np.concatenate([[0], common_prefixes(b, order, length) < length])) if len(order) else order
    owner = np.searchsorted(ends, order, "right")
    earliest = np.lexsort((order - first[owner], rank[owner], group))
    later = np.ones(len(order), bool)
    later[earliest[np.concatenate([[True], np.diff(group[earliest]) != 0])] if len(order) else []] = False
    flag = np.zeros(len(b), bool)
    flag[order[later]] = True
    return [flag[s : e + 1] for s, e in zip(first, last)]


def _compared(asked: DataFrame, docs: DataFrame, length: int, chunk: int = 1_000_000) -> DataFrame:
    """(rid, start, end) of bytes under repeated strings among runs to compare."""

    def fetch(batches):
        for batch in slices(batches):
            for rid, doc, text, at, f in zip(*(batch.column(k).to_pylist() for k in range(5))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                at = np.array(at, np.int64)
                start, n = at >> 8, at & 255
                seg = [raw[s : s + k + length - 1] for s, k in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(np.full(len(f), doc)), pa.array(np.full(len(f), rid)), pa.array(start), pa.array(seg, pa.binary())], names=["f", "doc", "rid", "start", "seg"])

    def settle(table: pa.Table) -> pa.RecordBatch:
        doc, rid, start = (table.column(c).to_numpy() for c in ("doc", "rid", "start"))
        seg = table.column("seg").to_pylist()
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((start, rid, doc))] = np.arange(len(doc))
        out = []
        for r, s, flags in zip(rid.tolist(), start.tolist(), repeated(seg, rank, length)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            out += [(r, s + a, s + b + length - 1) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rid", "start", "end"])

    def sort(batches):
        """Chunks that end where the anchor changes; rows come sorted by it."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > chunk:
                table = pa.Table.from_batches(held).combine_chunks()
                cuts = np.flatnonzero(np.diff(table.column("f").to_numpy())) + 1
                if len(cuts):
                    yield settle(table.slice(0, int(cuts[-1])))
                    held = table.slice(int(cuts[-1])).to_batches()
                    size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield settle(pa.Table.from_batches(held))
        give_back()

    lists = asked.groupBy("rid").agg(F.collect_list("at").alias("ats"), F.collect_list("f").alias("fs"))
    segments = docs.join(lists, "rid").select("rid", F.coalesce("id", F.lit(_LAST)).alias("doc"), "text", "ats", "fs", *[c for c in docs.columns if c == "box"]).mapInArrow(fetch, "f long, doc long, rid long, start long, seg binary")
    return segments.repartition("f").sortWithinPartitions("f").mapInArrow(sort, "rid long, start long, end long")


def _dealt_by_string(asked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The same as _compared for hot anchors: every string is dealt by its own 128-bit hash.

    Strings that occur twice within a slice of documents are settled before the shuffle, so that a string in very
    many documents is a row per slice, not per document; its rows then pass through a task one after another.
    """

    def fetch(batches):
        for batch in slices(batches):
            first: dict[bytes, tuple] = {}
            rows = []
            for rid, doc, text, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for x in at:
                    for s in range(x >> 8, (x >> 8) + (x & 255)):
                        h, mine = hashlib.blake2b(raw[s : s + length], digest_size=16).digest(), (doc, rid, s)
                        other = first.setdefault(h, mine)
                        if other != mine:
                            first[h] = min(other, mine)
                            rows.append((*max(other, mine), True, h))
            rows += [(*mine, False, h) for h, mine in first.items()]
            if rows:
                d, r, s, known, h = zip(*rows)
                key = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
                r, s, known = np.array(r, np.int64), np.array(s, np.int64), np.array(known)
                # settled ones need no partner and are dealt anywhere
                f = np.where(known, mix(mix(r.astype(np.uint64)) + s.astype(np.uint64)).view(np.int64), key[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(key[:, 1]), pa.array(d, pa.int64()), pa.array(r), pa.array(s), pa.array(known)], names=["f", "g", "doc", "rid", "start", "known"])

    def settle(batches):
        last = None
        for batch in batches:
            f, g, r, s = (np.asarray(batch.column(k)) for k in (0, 1, 3, 4))
            known = batch.column(5).to_numpy(zero_copy_only=False)
            again = known.copy()
            own = np.flatnonzero(~known)
            if len(own):
                same = np.zeros(len(own), bool)
                same[1:] = (f[own][1:] == f[own][:-1]) & (g[own][1:] == g[own][:-1])
                same[0] = last == (f[own[0]], g[own[0]])
                again[own] = same
                last = (f[own[-1]], g[own[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(r[again]), pa.array(s[again]), pa.array(s[again] + length)], names=["rid", "start", "end"])

    lists = asked.groupBy("rid").agg(F.collect_list("at").alias("ats"))
    strings = docs.join(lists, "rid").select("rid", F.coalesce("id", F.lit(_LAST)).alias("doc"), "text", "ats", *[c for c in docs.columns if c == "box"])
    strings = strings.mapInArrow(fetch, "f long, g long, doc long, rid long, start long, known boolean")
    return strings.repartition("f").sortWithinPartitions("f", "g", "doc", "rid", "start").mapInArrow(settle, "rid long, start long, end long")


def _settled(asked: DataFrame, docs: DataFrame, length: int, least: int, most: int) -> DataFrame:
    """(rid, start, end) of repeated strings among runs to compare.

    An anchor is hot if more runs have it than a thousandth of all, within least and most; there are few such
    anchors, and what a task holds of any other is bounded by ``most`` runs.
    """
    limit = min(most, max(least, asked.count() // 1000))
    t = F.pmod("f", F.lit(97))
    hot = asked.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("f", t.alias("t"))
    hot = stored(hot)
    if hot.isEmpty():
        return _compared(asked, docs, length)
    asked = asked.withColumn("t", t)
    cold = _compared(asked.join(hot, ["f", "t"], "left_anti"), docs, length)
    return cold.unionByName(_dealt_by_string(asked.join(hot, ["f", "t"], "left_semi"), docs, length))


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep: list[str] | None = None, with_text: bool = False, hot_least: int = 2048, hot_most: int = 200_000) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row (and the kept text, and the columns of ``keep``).

    Bytes under a string of ``length`` bytes that also starts earlier go; earlier is a smaller id (nulls last), for equal
    ids the earlier row, in one row the earlier start, so ties are settled by place and of repeated rows the first
    stays whole. Strings are judged on the input, overlaps count, and matches never cross rows. Null and empty texts
    have no bytes and come back with zeros and the digest of nothing; an empty table gives an empty table. Texts of any
    length go through in overlapping pieces. Rows are numbered once, in a stored table that all later steps read. ``with_text``
    gives ``kept_text``, the remaining bytes without those of characters that were cut in two (null where the text was).
    A column c of ``keep`` comes back as ``_keep_c``; on the way they are packed in one, so no name can clash.
    """
    keep = keep or []
    box = [boxed(df, keep).alias("box")] if keep else []
    docs = df.select(F.monotonically_increasing_id().alias("rid"), col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"), *box)
    docs = stored(docs)
    # both joins below read all of these columns, so that Spark shuffles the texts once and reuses the exchange
    dealt = _anchored(docs.select("rid", F.coalesce("id", F.lit(_LAST)).alias("doc"), "text"), length).repartition("f").sortWithinPartitions("f", "g", "e", "doc", "rid", "at")
    judged = stored(dealt.mapInArrow(lambda batches: _judge(batches, length), "f long, doc long, rid long, at long, ask boolean"))
    equal = judged.where("not ask").select("rid", F.col("at").alias("start"), F.col("f").alias("end"))
    spans = equal.unionByName(_settled(judged.where("ask"), docs, length, hot_least, hot_most)).groupBy("rid").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    schema = StructType.fromDDL(schema)
    if keep:
        schema = schema.add(docs.schema["box"])
    names = schema.names

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text, starts, ends in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                given = text.as_py()
                raw = (given or "").encode("utf-8", "surrogatepass")
                if starts:
                    mark = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(mark, np.array(starts), 1)
                    np.add.at(mark, np.array(ends), -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    spans_ = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    spans_, kept = 0, raw
                row = (len(raw), len(raw) - len(kept), spans_, hashlib.sha256(kept).hexdigest())
                rows.append((*row, None if given is None else kept.decode("utf-8", "ignore")) if with_text else row)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * (4 + with_text), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *([batch.column(4)] if keep else [])], names=names)

    joined = docs.join(spans, "rid", "left").select("id", "text", "starts", "ends", *(["box"] if keep else []))
    out = joined.mapInArrow(run, schema)
    own = [F.col("id").alias(id_col), *[c for c in names[1:] if c != "box"]]
    return out.select(*own, *[F.col(f"box.c{i}").alias(f"_keep_{c}") for i, c in enumerate(keep)])


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeated(load(spark, sf_dir, "documents"))
