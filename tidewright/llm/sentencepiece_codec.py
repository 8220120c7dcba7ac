"""Operator 2, SentencePiece encoding with seeded merge-dropout, and decoding.

BPE merges are taken from an agenda in order of score, as the public library does it. With
dropout, each candidate merge that comes up is skipped with that chance, and is then gone until a
neighbouring merge offers it again. Every segment of every document draws for itself: hashes keyed
by seed, document and the segment's place say how many candidates come up before each one that is
skipped. The result depends on nothing but seed, id and text. Decoding gives back every text exactly.

Texts are cut into segments where no piece of the vocabulary can reach across. All segments of a
portion of text are encoded in step, as rows of symbols in numpy: each round takes every row's
first candidate, and merges or skips it. Segments of equal symbols are merged without skips once;
those whose draw skips none of their candidates take that result.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import mixed, portions

DROPOUT = 0.1
#: Bytes of text that are encoded together; symbols of the longest segment that is a row, longer ones have
#: an agenda each. The result is the same for any.
PORTION, WIDE = 1_000_000, 48
SPACE = "▁"
MASK = (1 << 64) - 1
#: More candidates than any segment has; a pair that is no piece. One that is is its rank and, in the low
#: 32 bits, its symbol.
NEVER, NO_PIECE, LOW = 1 << 40, 1 << 62, (1 << 32) - 1
GOLDEN = 0x9E3779B97F4A7C15
#: Kinds of characters: line break, space, letter, sign or digit.
BREAK, BLANK, LETTER, SIGN = range(4)

_kinds: list = []


def kinds():  # noqa: ANN201
    """The kind of each code point."""
    import numpy as np

    if not _kinds:
        table = np.full(0x110000, SIGN, np.uint8)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = LETTER
        table[10], table[32] = BREAK, BLANK
        _kinds.append(table)
    return _kinds[0]


def gaps(base, turn, dropout: float):  # noqa: ANN001, ANN201
    """How many candidates of a segment with 64 bits `base` come up before its next skip, after `turn` skips:
    geometric, as if each candidate were drawn by itself."""
    import numpy as np

    if not 0 < dropout < 1:
        return np.full(len(base), NEVER if dropout <= 0 else 0, np.int64)
    draws = mixed(base + turn.astype(np.uint64) * np.uint64(GOLDEN), 5)
    found = np.log(((draws >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)) / math.log1p(-dropout)
    return np.minimum(found, NEVER).astype(np.int64)


class Codec:
    """The pieces of a SentencePiece BPE model with byte fallback and a dummy space before the text.

    Symbols are the pieces' characters and all pieces, numbered; a character of no piece is its code
    point beyond these."""

    def __init__(self, model: bytes) -> None:
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte = np.zeros(256, np.int32)
        found = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        if len(found) != 256:
            raise ValueError("the model has no byte fallback: its decoding cannot be exact")
        for value, i in found.items():
            self.byte[value] = i
        self.piece = {p: i for i, p in enumerate(pieces) if i not in special and not sp.is_byte(i)}
        self.order = {p: at for at, p in enumerate(sorted(self.piece, key=lambda p: (-sp.get_score(self.piece[p]), self.piece[p])))}
        self.bytes = [b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for value, i in found.items():
            self.bytes[i] = bytes([value])
        if any(b == SPACE and a != SPACE for p in self.piece for a, b in zip(p, p[1:])):  # noqa: B905
            raise ValueError("the model has pieces that reach across words")
        #: Where a vocabulary has pieces with a sign or digit after a letter, cuts are made before spaces only.
        self.coarse = any(a.isalpha() and not b.isalpha() for p in self.piece for a, b in zip(p, p[1:]))  # noqa: B905
        self._symbols()
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.ends = np.cumsum([0, *map(len, self.bytes)])

    def _symbols(self) -> None:
        """Numbers of symbols, and a hash table of the pairs that merge, with what they give."""
        import numpy as np

        names = list(dict.fromkeys([*(c for p in self.piece for c in p), *self.piece]))
        number = {p: i for i, p in enumerate(names)}
        self.n, self.names = len(names), names
        self.of_symbol = np.array([self.piece.get(p, -1) for p in names], np.int32)
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[32] = number.get(SPACE, -1)
        self.of_char[ord(SPACE)] = -1  # the text's own: its piece means a space
        rows = [(number[a] * self.n + number[b], self.order[p], number[p]) for p in self.piece for k in range(1, len(p)) if (a := p[:k]) in number and (b := p[k:]) in number]
        keys, rank, merged = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 3)
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.offers = np.full(len(self.slots), NO_PIECE, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # keys that find their slot taken try the next one
            free = self.slots[at] < 0
            take, first = np.unique(at[free], return_index=True)
            own = left[np.flatnonzero(free)[first]]
            self.slots[take], self.offers[take] = keys[own], rank[own] << 32 | merged[own]
            stay = self.slots[at] != keys[left]
            left, at = left[stay], at[stay] + 1

    def _slot(self, key):  # noqa: ANN001, ANN202
        import numpy as np

        return ((key.astype(np.uint64) * np.uint64(GOLDEN)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a, b):  # noqa: ANN001, ANN201
        """The rank and symbol of the piece that two symbols give, NO_PIECE if none."""
        import numpy as np

        key = np.where((a >= 0) & (b >= 0) & (a < self.n) & (b < self.n), a * self.n + b, -1)
        at = self._slot(key)
        seen = self.slots[at]
        out = np.where(seen == key, self.offers[at], NO_PIECE)
        far = np.flatnonzero((seen != key) & (seen >= 0))
        key, at = key[far], at[far]
        while len(far):  # the slot has another pair: the next one may have this
            at += 1
            seen = self.slots[at]
            out[far] = np.where(seen == key, self.offers[at], NO_PIECE)
            on = (seen != key) & (seen >= 0)
            far, key, at = far[on], key[on], at[on]
        return out

    def merge_rows(self, rows, offers, base=None, dropout: float = 0.0):  # noqa: ANN001, ANN201
        """The agenda of each row of symbols, all in step; -1 stands after a row's last symbol. offers are
        what its pairs give, base the rows' 64 bits."""
        import numpy as np

        width, who = rows.shape[1], np.arange(len(rows))
        out = rows.copy()
        turn, since = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        gap = gaps(base, turn, dropout) if base is not None else None
        columns = np.arange(width)
        while len(who):
            at = offers.argmin(1)
            line = np.arange(len(who))
            best = offers[line, at]
            open_ = best < NO_PIECE
            if not open_.all():
                out[who[~open_]] = rows[~open_]
                rows, offers, who, turn, since, at, best = (x[open_] for x in (rows, offers, who, turn, since, at, best))
                if base is not None:
                    base, gap = base[open_], gap[open_]
                line = line[: len(who)]
                if not len(who):
                    break
            on = line
            if base is not None and (skip := since == gap).any():
                offers[line[skip], at[skip]] = NO_PIECE
                turn[skip] += 1
                gap[skip], since[skip] = gaps(base[skip], turn[skip], dropout), 0
                on = np.flatnonzero(~skip)
            if not len(on):
                continue
            i = at[on][:, None]
            since[on] += 1
            # Symbols and pairs after the merged pair move up by one.
            every = on[:, None]
            own = rows[every, np.minimum(columns + (columns > i), width - 1)]
            own[line[: len(on)], i[:, 0]] = best[on] & LOW
            own[:, -1] = -1
            given = offers[every, np.minimum(columns[:-1] + (columns[:-1] >= i), width - 2)]
            given[:, -1] = NO_PIECE
            for side in (i[:, 0] - 1, i[:, 0]):
                k = np.flatnonzero((side >= 0) & (side < width - 1))
                c = side[k]
                given[k, c] = self.pair(own[k, c], own[k, c + 1])
            if len(on) == len(who):
                rows, offers = own, given
            else:
                rows[on], offers[on] = own, given
        return out

    def merge_heap(self, marks: list[int], base: int, dropout: float) -> list[int]:
        """The same for one segment of any length, with a heap and linked symbols."""
        import numpy as np

        n, turn, since = len(marks), 0, 0
        draw = lambda: int(gaps(np.array([base], np.uint64), np.array([turn]), dropout)[0])
        gap = draw()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        agenda: list[tuple] = []

        def put(places: list[int]) -> None:
            left = np.array([marks[a] for a in places], np.int64)
            right = np.array([marks[after[a]] for a in places], np.int64)
            for a, offer in zip(places, self.pair(left, right).tolist(), strict=True):
                if offer < NO_PIECE:
                    heapq.heappush(agenda, (offer >> 32, a, marks[a], marks[after[a]], offer & LOW))

        put([*range(n - 1)])
        while agenda:
            _, i, left, right, given = heapq.heappop(agenda)
            if marks[i] != left or (j := after[i]) < 0 or marks[j] != right:
                continue
            if since == gap:
                turn, since = turn + 1, 0
                gap = draw()
                continue
            since += 1
            marks[i], marks[j], after[i] = given, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            put([a for a in (before[i], i) if a >= 0 and after[a] >= 0])
        return [m for m in marks if m >= 0]

    def encode_all(self, texts: list[str], keys: list[int], dropout: float = 0.0):  # noqa: ANN201
        """Piece numbers of all texts on end, and where each text's start and end in them."""
        import numpy as np

        some = [i for i, t in enumerate(texts) if t]
        ends = np.zeros(len(texts) + 1, np.int64)
        if not some:
            return np.zeros(0, np.int32), ends
        chars = np.frombuffer("".join(" " + texts[i] for i in some).encode("utf-32-le"), np.uint32).astype(np.int64)
        heads = np.cumsum([0, *(len(texts[i]) + 1 for i in some)])
        kind = kinds()[chars]
        new = np.ones(len(chars), bool)
        if self.coarse:
            new[1:] = (kind[1:] == BLANK) & (kind[:-1] != BLANK)
        else:
            new[1:] = (kind[1:] == BREAK) | (kind[:-1] == BREAK) | (kind[1:] == BLANK) & (kind[:-1] != BLANK) | (kind[1:] == SIGN) & (kind[:-1] == LETTER)
        new[heads[:-1]] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(chars)))
        symbols = self.of_char[chars]
        symbols = np.where(symbols >= 0, symbols, chars + self.n)
        # A segment's 64 bits: of the document's key and the segment's place.
        first = np.searchsorted(start, heads[:-1])
        count = np.diff(np.append(first, len(start)))
        place = np.arange(len(start)) - np.repeat(first, count)
        base = mixed(np.repeat(np.array([keys[i] & MASK for i in some], np.uint64), count) + place.astype(np.uint64) * np.uint64(GOLDEN))

        lead, of = self._distinct(symbols, start, size)
        pairs = self.pair(symbols[:-1], symbols[1:])
        plain = self._merged(symbols, pairs, start[lead], size[lead], None, 0.0)
        lengths = np.diff(plain[1])
        # Without skips a segment has as many candidates as merges.
        varied = np.flatnonzero(gaps(base, np.zeros(len(base)), dropout) < (size[lead] - lengths)[of]) if dropout > 0 else np.zeros(0, np.int64)
        if dropout >= 1:
            varied = np.arange(len(start))
        drawn = self._merged(symbols, pairs, start[varied], size[varied], base[varied], dropout)
        # Of each segment the symbols of the one result or the other.
        pool, at, n = np.concatenate([plain[0], drawn[0]]), plain[1][:-1][of], lengths[of]
        at[varied], n[varied] = drawn[1][:-1] + len(plain[0]), np.diff(drawn[1])
        flat = pool[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ids, sizes = self._numbered(flat)
        stop = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n))]
        ends[np.array(some) + 1] = np.diff(stop[np.append(first, len(start))])
        return ids, np.cumsum(ends)

    def _distinct(self, symbols, start, size):  # noqa: ANN001, ANN202
        """A segment for each of equal symbols, and for each segment which of these it equals. Hashes
        find them, and the symbols themselves are compared."""
        import numpy as np

        sums = np.append(np.uint64(0), np.cumsum(mixed(symbols.astype(np.uint64), 3) * np.cumprod(np.full(len(symbols), GOLDEN | 1, np.uint64))))
        inverse = np.cumprod(np.append(np.uint64(1), np.full(len(symbols), pow(GOLDEN | 1, -1, 1 << 64), np.uint64)))
        code = mixed((sums[start + size] - sums[start]) * inverse[start], 4) + size.astype(np.uint64)
        _, lead, of = np.unique(code, return_index=True, return_inverse=True)
        like = start[lead[of]]
        every = np.arange(len(symbols)) - np.repeat(start, size)
        room = np.repeat(size[lead[of]], size)
        same = (every < room) & (symbols[np.repeat(like, size) + np.minimum(every, room - 1)] == symbols)
        odd = np.flatnonzero(~np.logical_and.reduceat(same, start) | (size != size[lead[of]]))
        of[odd] = len(lead) + np.arange(len(odd))
        return np.append(lead, odd), of

    def _merged(self, symbols, pairs, start, size, base, dropout: float):  # noqa: ANN001, ANN202
        """The symbols of segments after their agenda, on end, and where each starts and the last ends."""
        import numpy as np

        n, found = np.zeros(len(start), np.int64), []
        for width in np.unique(np.minimum(size, WIDE + 1)).tolist():
            if width > WIDE:
                for i in np.flatnonzero(size > WIDE).tolist():
                    own = self.merge_heap(symbols[start[i] : start[i] + size[i]].tolist(), int(base[i]) if base is not None else 0, dropout)
                    n[i] = len(own)
                    found.append((np.array([i]), np.array(own, np.int64)))
                continue
            rows = np.flatnonzero(size == width)
            every = start[rows][:, None] + np.arange(width)
            own = symbols[every]
            if width > 1:
                own = self.merge_rows(own, pairs[every[:, :-1]], None if base is None else base[rows], dropout)
            n[rows] = (own >= 0).sum(1)
            found.append((rows, own[own >= 0]))
        ends = np.append(0, np.cumsum(n))
        out = np.zeros(ends[-1], np.int64)
        for rows, own in found:
            k = n[rows]
            out[np.repeat(ends[rows] - (np.cumsum(k) - k), k) + np.arange(len(own))] = own
        return out, ends

    def _numbered(self, symbols):  # noqa: ANN001, ANN202
        """Piece numbers of symbols, and how many each has: a character that is no piece has those of its bytes."""
        import numpy as np

        ids = np.where(symbols < self.n, self.of_symbol[np.minimum(symbols, self.n - 1)], -1)
        odd = np.flatnonzero(ids < 0)
        sizes = np.ones(len(symbols), np.int64)
        if not len(odd):
            return ids.astype(np.int32), sizes
        kinds_, of = np.unique(symbols[odd], return_inverse=True)
        texts = [(self.names[x] if x < self.n else chr(x - self.n)).encode() for x in kinds_.tolist()]
        flat, ends = self.byte[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([0, *map(len, texts)])
        sizes[odd] = np.diff(ends)[of]
        out = np.repeat(ids, sizes)
        at = np.cumsum(sizes) - sizes
        k = sizes[odd]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out[np.repeat(at[odd], k) + inside] = flat[np.repeat(ends[:-1][of], k) + inside]
        return out.astype(np.int32), sizes

    def encode(self, text: str, key: int = 0, dropout: float = 0.0) -> list[int]:
        return self.encode_all([text], [key], dropout)[0].tolist()

    def decode_all(self, ids, ends) -> list[bytes]:  # noqa: ANN001
        """The bytes of all texts; each text's dummy space goes."""
        import numpy as np

        n = np.diff(self.ends)[ids]
        data = self.flat[np.repeat(self.ends[:-1][ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        stop = np.append(0, np.cumsum(n))[ends].tolist()
        return [data[a + 1 : b] for a, b in zip(stop, stop[1:])]  # noqa: B905

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


_codecs: dict[tuple, Codec] = {}


def _codec(model: bytes) -> Codec:
    """A worker keeps one codec for as long as it is asked for the same."""
    at = (zlib.crc32(model), len(model))
    if at not in _codecs:
        _codecs.clear()
        _codecs[at] = Codec(model)
    return _codecs[at]


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """The columns of df, and token_ids, n_tokens and lossless (decoding gave the text's bytes again).

    A null text has null token_ids, 0 tokens and is lossless; an empty text has no tokens. With
    dropout 0 the pieces are those of the public library. Rows that repeat id and text get the same
    pieces. Columns of df named like the new ones are replaced. An empty table gives an empty result.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    rows = df.drop("token_ids", "n_tokens", "lossless")
    names, place = rows.columns, rows.columns.index(text_col)
    keyed = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("key"))
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(rows.dtypes)) + ", token_ids array<int>, n_tokens int, lossless boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        codec = _codec(model)
        for whole in batches:
            room = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column(place)), 0))))
            for i, j in portions(room, PORTION):
                batch = whole.slice(i, j - i)
                texts = batch.column(place).to_pylist()
                ids, ends = codec.encode_all([t or "" for t in texts], batch.column(len(names)).to_pylist(), dropout)
                same = [back == (t or "").encode() for back, t in zip(codec.decode_all(ids, ends), texts, strict=True)]
                none = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=none)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], lists, pa.array(np.diff(ends), pa.int32()), pa.array(same, pa.bool_())], names=[f"c{i}" for i in range(len(names))] + ["token_ids", "n_tokens", "lossless"]
                )

    return keyed.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "token_ids", "n_tokens", "lossless")


def decode(df: DataFrame, model_path: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """df with out_col: the text of ids_col (null for null)."""
    with open(model_path, "rb") as f:
        model = f.read()

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        codec = _codec(model)
        return ids.map(lambda x: None if x is None else codec.decode(x).decode())

    return df.withColumn(out_col, text_of(F.col(ids_col)))
