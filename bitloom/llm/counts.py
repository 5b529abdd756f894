"""Edit-aware token counts (operator 6).

A text is cut before each single blank between two non-blank characters. Such a place always is a pre-token
boundary of the byte-level tokeniser, whatever stands further away, so the parts (a word with its blank, or
a run of words that odd white space keeps together) can be counted one by one. A document's parts are the leaves,
sixteen at a time, of a segment tree that sums characters and tokens. An edit finds its leaves by descent,
re-encodes the parts it touches and one part on either side (the boundaries there depend on their first and
last characters), and updates the sums on the paths to the root. Trees are kept as tables of counts; edits come as a
table, meet them in a join, and give new trees.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, col, load, slices, stored

_CUT = re.compile(r"(?<=\S) (?=\S)")
LEAF = 16


def parts_of(text: str) -> list[str]:
    """The parts of a text; all but the first begin with a blank."""
    if not text:
        return []
    first, *rest = _CUT.split(text)
    return [first, *[" " + r for r in rest]]


def counter(path: str) -> WordCache:
    """Cached token counts of parts by a tiktoken rank file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return WordCache(lambda parts: [len(enc.encode_ordinary(p)) for p in parts])


class TokenTree:
    """Segment tree of a text's parts: leaves of up to LEAF parts, sums of characters and tokens above them.

    ``tokens`` are the counts of the text's parts where they are known; then nothing is encoded.
    """

    def __init__(self, text: str, count: WordCache, tokens: list[int] | None = None):
        self.count, self.encoded = count, 0
        parts = parts_of(text)
        self._build(parts, count.all(parts) if tokens is None else tokens)

    def _build(self, parts: list[str], tokens: list[int]) -> None:
        if len(parts) != len(tokens):
            raise ValueError("as many counts as parts")
        n = max(1, -(-len(parts) // LEAF))
        self.size = 1 << (n - 1).bit_length()
        self.leaves = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.counts = [tokens[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if parts:
            at = np.arange(0, len(parts), LEAF)
            self.sums[self.size : self.size + n, 0] = np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), at)
            self.sums[self.size : self.size + n, 1] = np.add.reduceat(np.array(tokens, np.int64), at)
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def text(self) -> str:
        return "".join("".join(x) for x in self.leaves)

    def _leaf(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one for the end of the text), and where it begins."""
        node, start = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if char >= start + left and self.sums[node + 1, 0]:
                start += left
                node += 1
        return min(node - self.size, len(self.leaves) - 1), start

    def part_counts(self) -> list[int]:
        """The counts of the parts, from which the tree can be had again without encoding."""
        text, own = self.text, [n for x in self.counts for n in x]
        # an edit may leave a cut where parts_of makes none; such parts are counted together
        cuts = np.cumsum([len(p) for p in parts_of(text)])
        at = np.searchsorted(np.cumsum([len(p) for x in self.leaves for p in x]), cuts, "left")
        sums = np.concatenate([[0], np.cumsum(own)])[at + 1] if len(cuts) else np.zeros(0, np.int64)
        return np.diff(sums, prepend=0).tolist()

    def _set(self, leaf: int, parts: list[str], tokens: list[int]) -> None:
        self.leaves[leaf], self.counts[leaf] = parts, tokens
        node = leaf + self.size
        self.sums[node] = sum(map(len, parts)), sum(tokens)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters start to end (exclusive) by new; returns how many parts were encoded again."""
        if not 0 <= start <= end <= self.chars:
            raise ValueError(f"no characters {start} to {end} in a text of {self.chars}")
        first, at = self._leaf(start)
        # one part before the edit belongs to it; it may be the last of the leaf before
        while first > 0 and (start == at or len(self.leaves[first]) == 0 or start < at + len(self.leaves[first][0]) + 1):
            first -= 1
            at -= int(self.sums[first + self.size, 0])
            if self.leaves[first]:
                break
        last, low = self._leaf(end)
        high = low + int(self.sums[last + self.size, 0])
        # and so does the part behind it; it may be the first of the leaf behind
        while last + 1 < len(self.leaves) and (not self.leaves[last] or end >= high - len(self.leaves[last][-1])):
            last += 1
            high += int(self.sums[last + self.size, 0])
            if self.leaves[last]:
                break
        parts = [p for x in self.leaves[first : last + 1] for p in x]
        tokens = [n for x in self.counts[first : last + 1] for n in x]
        ends = at + np.cumsum([len(p) for p in parts])
        lo = max(0, int(np.searchsorted(ends, start, "left")) - 1)  # the part that the edit begins in or ends, and one before
        hi = min(len(parts), int(np.searchsorted(ends, end, "right")) + 2)
        begin = int(ends[lo - 1]) if lo else at
        old = "".join(parts[lo:hi])
        changed = old[: start - begin] + new + old[end - begin :]
        if lo or first:  # the region begins at a boundary that stays
            again = parts_of("x" + changed)
            again = [again[0][1:], *again[1:]]
            again = again if again[0] else again[1:]
        else:
            again = parts_of(changed)
        parts[lo:hi] = again
        tokens[lo:hi] = self.count.all(again)
        self.encoded += len(again)
        if len(parts) > 8 * LEAF * (last - first + 1):  # grown too much for its leaves
            flat = lambda xs, own: [y for x in xs[:first] for y in x] + own + [y for x in xs[last + 1 :] for y in x]
            self._build(flat(self.leaves, parts), flat(self.counts, tokens))
        else:
            per = -(-len(parts) // (last - first + 1)) or 1
            for k, leaf in enumerate(range(first, last + 1)):
                self._set(leaf, parts[k * per : (k + 1) * per], tokens[k * per : (k + 1) * per])
        return len(again)


def script(doc, text: str) -> list[tuple[int, int, str]]:
    """The query's edits of a document: one replaced, one inserted and one deleted span, placed by a checksum."""
    seed, n, out = zlib.crc32(f"{doc}".encode()), len(text), []
    for k, new in enumerate(("reviewed text", " and added words", "")):
        start = (seed >> (5 * k)) % (n + 1)
        end = start if k == 1 else min(n, start + 7 + (seed >> (3 * k)) % 23)
        out.append((start, end, new))
        n += len(new) - (end - start)
    return out


_STATE: dict = {}


def _count(path: str) -> WordCache:
    if path not in _STATE:
        _STATE.clear()
        _STATE[path] = counter(path)
    return _STATE[path]


def count_edited(df: DataFrame, ranks_path: str, edits=script, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens (before), n_tokens_edited, n_parts (leaves' parts before), n_encoded (again, for the edits).

    ``edits(id, text)`` gives (start, end, new) in code points, each on the text that the one before left. Null
    texts count as empty, and empty ones have no parts; texts of any length are held one at a time. One row per input row, repeated
    ones too; extra columns are ignored, whatever their names; an empty table gives an empty table; nothing is shuffled.
    """
    names = [id_col, "n_tokens", "n_tokens_edited", "n_parts", "n_encoded"]

    def run(batches):
        count = _count(ranks_path)
        for batch in slices(batches):
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py() or ""
                tree = TokenTree(text, count)
                before, n = tree.tokens, sum(map(len, tree.leaves))
                for e in edits(doc, text):
                    tree.edit(*e)
                rows.append((doc, before, tree.tokens, n, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=names)

    schema = ", ".join(f"`{n}` long" for n in names)
    return df.select(col(id_col).cast("long").alias(id_col), col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _digest():
    """Tells the texts of one id, and of no id, apart."""
    return F.xxhash64("text", F.when(F.col("id").isNull(), "none").otherwise("tree"))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", _digest())


def packed(counts: list[int]) -> bytes:
    """Counts as compressed little-endian 32-bit numbers: most are 1 to 3, so little is left of them."""
    return zstandard.compress(np.array(counts, "<u4").tobytes(), 3)


def unpacked(kept: bytes) -> list[int]:
    return np.frombuffer(zstandard.decompress(kept), "<u4").tolist()


def trees(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, counts) of every row: the token counts of a text's parts, ``packed``.

    This is what is kept of a document's tree: its parts follow from the text and the sums from the counts, so
    ``edited`` takes the tree up again without encoding. Null texts count as empty; repeated rows give equal trees.
    """

    def run(batches):
        count = _count(ranks_path)
        for batch in slices(batches):
            kept = [packed(count.all(parts_of(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(kept, pa.binary())], names=["id", "digest", "counts"])

    return _texts(df, id_col, text_col).mapInArrow(run, "id long, digest long, counts binary")


def edited(df: DataFrame, kept: DataFrame, edits: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_trees: bool = False) -> DataFrame:
    """id, n_tokens (before), n_tokens_edited, n_parts (before), n_encoded (parts encoded for the edits) of every row.

    ``kept`` are the ``trees`` of the same rows, and ``edits`` has id, seq, start, end, new: characters start to end (in code
    points, exclusive) become new. Edits of a document follow each other by seq (ties: by start, end, new), each on
    the text that the one before left; places beyond a text's ends count as its ends, a null new as empty, and edits
    without an id, start or end are ignored, as are those of unknown ids. ``with_trees`` adds text, digest and counts after
    the edits, to be kept for the next ones.

    Null and empty texts have no parts; rows that share an id get the same edits, each on its own text; rows without
    an id have none; texts of any length are held one at a time; other columns are ignored, whatever their names; empty
    tables give empty ones. The edits of one document are gathered in one task; a text is shuffled once, compressed, to meet them. A
    text whose tree isn't among the kept ones is an error, as its edits would be lost.
    """
    names = ["id", "n_tokens", "n_tokens_edited", "n_parts", "n_encoded", *(["text", "digest", "counts"] if with_trees else [])]

    def pack(batches):
        for batch in slices(batches):
            z = [zstandard.compress(t.as_py().encode("utf-8", "surrogatepass"), 3) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(z, pa.binary())], names=["id", "digest", "z"])

    def run(batches):
        count = _count(ranks_path)
        for batch in slices(batches):
            rows = []
            for doc, z, had, todo in zip(*(batch.column(k).to_pylist() for k in range(4))):
                text = zstandard.decompress(z).decode("utf-8", "surrogatepass")
                if had is None:
                    raise ValueError(f"no tree is kept of the text of document {doc}")
                tree = TokenTree(text, count, unpacked(had))
                before, n = tree.tokens, sum(map(len, tree.leaves))
                for e in todo or []:
                    start = min(max(e["start"], 0), tree.chars)
                    tree.edit(start, min(max(e["end"], start), tree.chars), e["new"])
                row = (doc, before, tree.tokens, n, tree.encoded)
                rows.append((*row, tree.text, None, packed(tree.part_counts())) if with_trees else row)
            kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    known = edits.where("id is not null and start is not null and end is not null")
    lists = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", F.coalesce("new", F.lit("")).alias("new")))).alias("edits"))
    # trees and texts each move once, by one key; edits, which are small, go to the keys of their id first
    key = ["k", "digest"]
    k = F.coalesce("id", F.lit(0)).alias("k")
    own = kept.select("id", k, "digest", "counts")
    due = own.where("id is not null").select("id", *key).distinct().join(lists, "id").select(*key, "edits")
    texts = _texts(df, id_col, text_col).mapInArrow(pack, "id long, digest long, z binary").select("id", k, "digest", "z")
    rows = texts.join(own.drop("id").dropDuplicates(key), key, "left").join(due, key, "left").select("id", "z", "counts", "edits")
    schema = "id long, n_tokens long, n_tokens_edited long, n_parts long, n_encoded long" + (", text string, digest long, counts binary" if with_trees else "")
    out = rows.mapInArrow(run, schema)
    if with_trees:
        out = out.withColumn("digest", _digest())
    return out.withColumnRenamed("id", id_col)


def edit_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The edits of ``script`` as a table (id, seq, start, end, new), by DataFrame functions alone."""
    own = df.select(col(id_col).cast("long").alias("id"), F.coalesce(F.length(col(text_col).cast("string")), F.lit(0)).cast("long").alias("n")).where("id is not null").dropDuplicates(["id"])
    seeded = own.withColumn("seed", F.crc32(F.col("id").cast("string").cast("binary")))
    rows, n = [], F.col("n")
    for k, new in enumerate(("reviewed text", " and added words", "")):
        start = F.shiftright("seed", 5 * k) % (n + 1)
        end = start if k == 1 else F.least(n, start + 7 + F.shiftright("seed", 3 * k) % 23)
        rows.append(F.struct(F.lit(k).alias("seq"), start.alias("start"), end.alias("end"), F.lit(new).alias("new")))
        n = n + len(new) - (end - start)
    return seeded.select("id", F.explode(F.array(*rows)).alias("e")).select("id", "e.*")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents, path = load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return edited(documents, stored(trees(documents, path)), edit_table(documents), path)
