"""Vector bin packing of tokenised documents into fixed-length sequences (operator 10).

Every sequence obeys three limits at once: tokens, segments (pieces) and loss-bearing tokens. A
document longer than a sequence gives full sequences of its own; what remains is placed by the
dot-product heuristic: a bin takes, of all items that fit, the one whose demands, weighted by the mean load
per dimension, have the largest scalar product with the bin's free capacities, until none fits. Bins that stay partly free are
filled by cutting further pieces, and what is left then is cut into power-of-two sequences, which need no padding.

Each task packs its own rows in chunks of bounded size, so nothing is shuffled. Sequence ids are the
partition's number times 2**40 plus a counter: they are the same when a lost task runs again.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import WordCache, col, give_back, load, slices

END_ID = 2


@dataclass(frozen=True)
class Limits:
    """tokens: length of a sequence; segments: pieces in it; loss: loss-bearing tokens in it."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Packer:
    """Packs items (key, length, loss length) into bins; bins are returned as lists of (key, start, length)."""

    def __init__(self, limits: Limits = Limits()):
        if min(limits.tokens, limits.segments, limits.loss) < 1 or limits.loss > limits.tokens:
            raise ValueError("limits must be positive, and loss at most tokens")
        self.limits = limits

    def pack(self, lengths: np.ndarray, loss: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Bins of (item, start, length). Items are cut only where they exceed a bin's tokens or loss, or fill the last bins.

        loss gives the loss-bearing tokens of each item, which are its last ones.
        """
        lim, done, rest = self.limits, [], []
        for i, (n, k) in enumerate(zip(lengths.tolist(), loss.tolist())):
            start = 0
            while start < n:
                size = min(lim.tokens, n - start)
                if self._loss(n, k, start, size) > lim.loss:
                    size = self._fitting(n, k, start, size, lim.loss)
                if size < lim.tokens:
                    rest.append((i, start, size, self._loss(n, k, start, size)))
                else:
                    done.append([(i, start, size)])
                start += size
        return done + self._place(rest, lengths, loss)

    @staticmethod
    def _loss(n: int, k: int, start: int, size: int) -> int:
        """Loss-bearing tokens of a piece; the last k of n are."""
        return max(0, start + size - max(start, n - k))

    def _fitting(self, n: int, k: int, start: int, size: int, most: int) -> int:
        """The longest piece from start with at most ``most`` loss-bearing tokens."""
        return min(size, max(0, n - k - start) + most)

    def _place(self, rest: list, lengths, loss) -> list:
        """Every piece has one segment, so that dimension is a count, and adds the same to all products of a bin."""
        lim, bins = self.limits, []
        size, bear = (np.array([r[c] for r in rest], np.int64) for c in (2, 3))
        if not rest:
            return self._fill(bins, lengths, loss)
        along, across = (x / cap * (x.mean() / cap) for x, cap in ((size, lim.tokens), (bear, lim.loss)))
        order = np.lexsort((np.arange(len(rest)), -(along + across)))  # ties of the product go to the larger, then the earlier
        size, bear, along, across = size[order], bear[order], along[order], across[order]
        while len(order):
            held, fit = [], np.arange(len(order))
            tokens, segments, bearing = lim.tokens, lim.segments, lim.loss
            j = 0  # of an empty bin, the first has the largest product
            while True:
                held.append(j)
                tokens, segments, bearing = tokens - int(size[j]), segments - 1, bearing - int(bear[j])
                fit = fit[(size[fit] <= tokens) & (bear[fit] <= bearing) & (fit != j)]  # what doesn't fit now won't fit later
                if not segments or not len(fit):
                    break
                j = int(fit[(along[fit] * (tokens / lim.tokens) + across[fit] * (bearing / lim.loss)).argmax()])
            bins.append([rest[order[j]][:3] for j in held])
            left = np.ones(len(order), bool)
            left[held] = False
            order, size, bear, along, across = order[left], size[left], bear[left], along[left], across[left]
        return self._fill(bins, lengths, loss)

    def _fill(self, bins: list, lengths, loss) -> list:
        """Take the emptiest bins apart and cut their pieces to fill the others; power-of-two bins for the rest."""
        lim, out = self.limits, []
        size_of = lambda b: sum(p[2] for p in b)
        of = lambda p: self._loss(int(lengths[p[0]]), int(loss[p[0]]), p[1], p[2])
        bins = sorted(bins, key=size_of)
        give: list = []  # pieces to cut, the last first
        low = 0
        for at in range(len(bins) - 1, -1, -1):
            b = bins[at]
            if at < low:
                break
            tokens, parts, k = size_of(b), len(b), sum(map(of, b))
            while tokens < lim.tokens and parts < lim.segments:
                if not give:
                    if low >= at:
                        break
                    give, low = bins[low][::-1], low + 1
                fits = [self._fitting(int(lengths[i]), int(loss[i]), start, min(size, lim.tokens - tokens), lim.loss - k) for i, start, size in give]
                at_ = max((x for x, t in enumerate(fits) if t > 0), default=None)  # a bin full of loss takes prompts alone
                if at_ is None:
                    break
                (i, start, size), take = give.pop(at_), fits[at_]
                n, kk = int(lengths[i]), int(loss[i])
                b.append((i, start, take))
                tokens, parts, k = tokens + take, parts + 1, k + self._loss(n, kk, start, take)
                if take < size:
                    give.append((i, start + take, size - take))
            out.append(b)
        if give:
            out.append(give[::-1])
        final = []
        for b in out:
            final += [b] if size_of(b) == lim.tokens else self._powers(b)
        return final

    def _powers(self, b: list) -> list:
        """Cut a bin that isn't full into bins whose sizes are powers of two."""
        total, out, todo = sum(p[2] for p in b), [], list(b[::-1])
        while total:
            size = 1 << (total.bit_length() - 1)
            cur, room = [], size
            while room:
                i, start, n = todo.pop()
                take = min(n, room)
                cur.append((i, start, take))
                if take < n:
                    todo.append((i, start + take, n - take))
                room -= take
            out.append(cur)
            total -= size
        return out


class Tokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers.

    White space always ends a pre-token of this tokenizer and is dropped, so the words between blanks and line
    feeds are encoded one by one, each distinct one once per cache generation. Where it changes nothing
    (no special token, only characters whose lower case and normal form are plain) texts are lower-cased first.
    """

    letters = re.compile(r"[a-zà-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), WordCache(self._encoded, cap=400_000)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Words of letters go 500 at a time as one text, and are told apart by their last ids, which end a word."""
        plain = [w for w in words if self.letters.fullmatch(w)]
        lines = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        out: dict[str, bytes] = {}
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False) if lines else []):
            ids = np.array(e.ids, "<u4")
            cut = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(cut) == len(line):
                raw = ids.tobytes()
                out.update(zip(line, [raw[s:t] for s, t in zip([0, *cut], cut)]))
        rest = [w for w in words if w not in out]
        if rest:
            out.update(zip(rest, [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]))
        return [out[w] for w in words]

    def all(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and their offsets (len + 1)."""
        own = []
        for t in texts:
            if "<|" not in t:
                try:
                    t.encode("latin-1")
                    t = t.lower()
                except UnicodeEncodeError:
                    pass
            own.append(t.replace("\n", " "))
        # punctuation that ends a word behind a letter is a pre-token of its own
        apart = pc.replace_substring_regex(pa.array(own, pa.large_string()), "([a-zà-öø-ÿ])([.,;:!?|]+)( |$)", r"\1 \2\3")
        parts = pc.split_pattern(apart, " ")
        words = parts.values.dictionary_encode()
        raw = self.words.all(words.dictionary.to_pylist())  # of each distinct word once
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        starts, code = np.cumsum(sizes) - sizes, np.asarray(words.indices)
        n = sizes[code]
        before = np.concatenate([[0], np.cumsum(n)])
        flat = np.frombuffer(b"".join(raw), "<u4")
        offsets = before[np.asarray(parts.offsets)]
        ids = flat[np.repeat(starts[code] - before[:-1], n) + np.arange(before[-1])]
        return np.insert(ids, offsets[1:], end_id).astype("<u4"), offsets + np.arange(len(offsets))


_STATE: dict = {}


def _tokenizer(path: str) -> Tokenizer:
    if path not in _STATE:
        _STATE.clear()
        _STATE[path] = Tokenizer(path)
    return _STATE[path]


def pack_documents(df: DataFrame, tokenizer_path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, chunk_tokens: int = 2_000_000, chunk_rows: int = 8000, with_ids: bool = False, loss_col: str | None = None, prompt_share: float = 0.0) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null or empty text has its end id alone. Documents are told apart by row, so repeated rows
    and repeated ids are packed each for itself; items of equal demands are placed in the order of their rows. Texts of any
    length are encoded whole and cut. ``loss_col`` gives how many of a document's
    ids, its last ones with the end id, bear loss (below 0 counts as 0, more than there are as all, null as all);
    without it all do but the first ``prompt_share`` of them (rounded down), which count as its prompt. A task holds at most
    about ``chunk_tokens`` ids or ``chunk_rows`` documents, and a slice of 500 documents, at a time. Other columns are ignored, whatever their names; an empty table
    gives an empty table.
    """
    schema = f"id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")

    def flush(docs, ids, bearing, packer, base):
        lengths = np.array([len(x) for x in ids], np.int64)
        loss = np.array([n if k is None else min(max(k, 0), n) for k, n in zip(bearing, lengths.tolist())], np.int64) if loss_col else lengths - np.floor(lengths * prompt_share).astype(np.int64)
        rows = []
        bins = packer.pack(lengths, loss)
        for s, b in enumerate(bins):
            offset = 0
            for i, start, n in b:
                raw = ids[i][start : start + n]
                row = (docs[i], start, n, zlib.crc32(raw), int(lengths[i]), base + s, offset)
                rows.append((*row, raw.astype(np.int64)) if with_ids else row)
                offset += n
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names), len(bins)

    def run(batches):
        tokenizer, packer = _tokenizer(tokenizer_path), Packer(limits)
        base, docs, ids, bearing, held = TaskContext.get().partitionId() << 40, [], [], [], 0
        for part in slices(batches, 500):
            flat, offsets = tokenizer.all([t or "" for t in part.column(1).to_pylist()], end_id)
            docs += part.column(0).to_pylist()
            ids += [flat[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            if loss_col:
                bearing += part.column(2).to_pylist()
            held += len(flat)
            if held >= chunk_tokens or len(docs) >= chunk_rows:
                out, n = flush(docs, ids, bearing, packer, base)
                yield out
                base, docs, ids, bearing, held = base + n, [], [], [], 0
        if docs:
            yield flush(docs, ids, bearing, packer, base)[0]
        tokenizer.words.forget()
        give_back()

    columns = [col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")]
    if loss_col:
        columns.append(col(loss_col).cast("long").alias("loss"))
    return df.select(*columns).mapInArrow(run, schema).withColumnRenamed("id", id_col)


#: Instruction data: at most 32 examples and 3840 loss-bearing ids in a sequence; the first quarter of a document is its prompt.
INSTRUCTION = {"limits": Limits(4096, 32, 3840), "prompt_share": 0.25}


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), **INSTRUCTION)
