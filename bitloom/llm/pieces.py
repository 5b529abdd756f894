"""SentencePiece BPE encoding by backtracking, and decoding (operator 1).

A piece model is read from its protocol-buffer file. A text becomes units (a run of word marks and
the characters up to the next run); no piece has a mark behind another character, so no merge ever
crosses a unit and units are encoded one by one, each distinct unit once per cache generation.

Within a unit an Aho-Corasick automaton gives all pieces at all positions. The encoder takes the
longest piece, checks it against the piece before by re-merging the two (the merge loop must give
back exactly this pair), falls back to shorter pieces, and when none fits clears the position in a
bitfield of positions from which no valid encoding continues and steps back one piece. A pair fits if the merge
loop over both pieces' characters gives back the pair.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordCache, col, load, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        i += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, i
        shift += 7


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        wire = tag & 7
        if wire == 0:
            value, i = _varint(data, i)
        elif wire == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if wire == 5 else 8
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and kinds of a BPE model with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.kinds, trainer, normalizer = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                self.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or normalizer.get(1) != b"identity" or normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only BPE models with the identity normaliser that keep white space are supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER, UNUSED)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.eos = self.pieces.index("</s>")
        odd = [p for p in self.ids if MARK in p.lstrip(MARK) or not set(p) <= self.chars]
        if odd or len(self.bytes) != 256:
            raise ValueError(f"pieces that this encoder doesn't know: {odd[:3]}")


class PieceEncoder:
    """Exact encoding and decoding; ``pairs`` bounds the memo of compatible pairs."""

    def __init__(self, path: str, pairs: int = 400_000):
        import ahocorasick

        self.model = m = PieceModel(path)
        self.automaton = ahocorasick.Automaton()
        for p, i in m.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        order = {x: r for r, x in enumerate(sorted({m.scores[i] for i in m.ids.values()}), 1)}
        self.ranks = {p: order[m.scores[i]] for p, i in m.ids.items()}  # the higher, the earlier a pair merges
        self.pairs, self.known, self.longest = pairs, {}, max(map(len, m.ids))
        self.n = len(m.pieces)

    def merged(self, text: str) -> list[str]:
        """The merge loop itself: always the adjacent pair of the best score, the leftmost of equals.

        The scores of pairs stand beside the parts, so that a merge looks up no more than the two pairs it makes.
        """
        rank, parts = self.ranks.get, list(text)
        pairs = [rank(a + b, 0) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)):
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], 0)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], 0)
        return parts

    def fits(self, left: int, right: int) -> bool:
        key = left * self.n + right
        ok = self.known.get(key)
        if ok is None:
            a, b = self.model.pieces[left], self.model.pieces[right]
            ok = self.merged(a + b) == [a, b]
            if len(self.known) >= self.pairs:
                self.known.clear()
            self.known[key] = ok
        return ok

    def _matches(self, text: str, start: int, size: int) -> list[list]:
        """For each of the ``size`` positions from start, the pieces there as (size, id), by ascending size."""
        stop = min(len(text), start + size + self.longest)
        at: list[list] = [[] for _ in range(start, stop)]
        for end, match in self.automaton.iter(text, start, stop):
            at[end + 1 - start - match[0]].append(match)  # shorter ones of a start end earlier
        return at

    def _run(self, text: str, block: int = 4096) -> list[int]:
        """Encode characters that all are pieces by themselves.

        Matches are held for blocks of positions, and found again if the search steps back into a block that was let
        go; failed positions are bits of one number a block.
        """
        n, held, current, at = len(text), {}, -1, []
        live = [(1 << min(block, n + 1)) - 1] * (n // block + 1)  # bit p: an encoding may still continue from p
        tokens: list[tuple[int, int, int]] = []  # (id, size, index among the options of its start)
        pos, k, last = 0, None, -1
        while pos < n:
            b, p = divmod(pos, block)
            if b != current:
                if b not in held:
                    held = {x: m for x, m in held.items() if abs(x - b) == 1}
                    held[b] = self._matches(text, b * block, block)
                current, at = b, held[b]
            here = at[p]
            if k is None:  # not been here by this way
                k = len(here) - 1
            while k >= 0:
                size, i = here[k]
                end = pos + size
                if live[end // block] >> (end % block) & 1 and (last < 0 or self.fits(last, i)):
                    break
                k -= 1
            if k >= 0:
                tokens.append((i, size, k))
                pos, k, last = pos + size, None, i
            else:
                live[b] &= ~(1 << p)
                if not tokens:
                    raise AssertionError("no encoding")
                _, size, k = tokens.pop()
                pos, k, last = pos - size, k - 1, tokens[-1][0] if tokens else -1
        return [t[0] for t in tokens]

    def unit(self, text: str) -> list[int]:
        chars = self.model.chars
        if chars.issuperset(text):
            return self._run(text)
        out, start = [], 0
        for i, c in enumerate(text):
            if c not in chars:  # never part of a piece: its bytes
                if i > start:
                    out += self._run(text[start:i])
                out += [self.model.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        if start < len(text):
            out += self._run(text[start:])
        return out

    def units(self, text: str) -> list[str]:
        """Units without the first mark of each; an empty text has none."""
        if not text:
            return []
        s = text.replace(" ", MARK)
        if self.model.dummy_prefix:
            s = MARK + s
        elif s[0] != MARK:
            raise ValueError("models without the dummy prefix aren't supported")
        if MARK + MARK in s:
            return [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", s)]
        return s[1:].split(MARK)

    def encode(self, text: str | None, eos: bool = True) -> list[int]:
        out = [i for u in self.units(text or "") for i in self.unit(MARK + u)]
        return [*out, self.model.eos] if eos else out

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids with word marks as spaces, the first one still there."""
        m, out, raw = self.model, [], bytearray()
        for i in [*ids, None]:
            kind = m.kinds[i] if i is not None else None
            if kind == BYTE:
                raw.append(int(m.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(_text_of(bytes(raw)))
                raw.clear()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind is not None and kind != CONTROL:
                out.append(m.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The mark of the first piece that isn't a control piece is the dummy prefix, and goes."""
        m, text = self.model, self.decode_part(ids)
        first = next((i for i in ids if m.kinds[i] != CONTROL), None)
        strip = m.dummy_prefix and first is not None and m.kinds[first] not in (UNKNOWN, BYTE) and m.pieces[first].startswith(MARK)
        return text[1:] if strip else text


def _text_of(raw: bytes) -> str:
    """UTF-8 text; each byte that belongs to no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_STATE: dict = {}


def _state(path: str):
    if path not in _STATE:
        enc = PieceEncoder(path)

        def compute(units):
            out = []
            for u in units:
                ids = enc.unit(MARK + u)
                out.append((" ".join(map(str, ids)), enc.decode_part(ids)))
            return out

        _STATE.clear()
        _STATE[path] = enc, WordCache(compute)
    return _STATE[path]


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every whole text (with an end id) and the text that they decode to, as counts and digests.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded themselves.
    A null or empty text has the end id alone. One row comes out for each row that goes in, repeated
    ones too; of equal scores the leftmost pair merges, as in the library; units of any length go through the same search, a
    block of matches at a time; other columns are ignored, whatever their names; an empty table gives an empty table.
    Nothing is shuffled; a task holds one Arrow batch and its cache.
    """
    schema = f"id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        enc, cache = _state(model_path)
        sha = hashlib.sha256
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = cache.all(enc.units(text.as_py() or ""))
                ids = " ".join([*(g[0] for g in got), str(enc.model.eos)])
                decoded = "".join([g[1] for g in got])
                if got and decoded[:1] == " ":
                    decoded = decoded[1:]
                row = (doc, ids.count(" ") + 1, sha(ids.encode()).hexdigest(), sha(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                rows.append((*row, list(map(int, ids.split())), decoded) if with_ids else row)
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return df.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
