"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE model's pieces and scores are read on the driver from the model file that is given (nothing is trained). Encoding is the
agenda algorithm: of a chunk's neighbouring symbols that make a piece, the best by score, and the leftmost of equals, is merged
first. With dropout each candidate (its left, middle and right place in the text) is skipped if its own draw, a hash of these places
keyed by seed and document, is below the rate: every occurrence of every word in every document has draws of its own, and
equal seeds give equal pieces everywhere. Without dropout the pieces are the model's own. Characters that the model lacks become
byte pieces, and so does a literal U+2581, which would read as a space: decoding gives back every text.

Chunks end where two characters meet that stand side by side in no piece: no merge crosses such a place. All chunks of a batch
have an agenda each, and numpy takes one merge of each chunk per step; the few chunks longer than STEPPED take a heap each.

Ids are kept as little-endian unsigned 32-bit numbers in a binary column.

Defined cases: a null text has null ids and is null again when decoded; an empty text has no ids. Texts of any length are
encoded whole (long ones in several spans that end between chunks). Repeated rows (same key and text) have equal ids; a null key
is the key "". Result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .words import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20240229
#: Symbols of a chunk up to which it is merged in step with others; characters of a batch.
STEPPED, SPAN = 64, 1 << 20
SPACE = "▁"
NONE = np.int32(2**31 - 1)
_STRIDES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MASK = (1 << 64) - 1


class PairTable:
    """A fixed map from pairs of numbers below 2**20 to numbers, by open addressing: looked up for whole arrays."""

    def __init__(self, entries: dict[tuple[int, int], int]):
        self.bits = max(8, (4 * len(entries)).bit_length())
        keys = np.array([a << 20 | b for a, b in entries] or [0], np.int64)[: len(entries)]
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, value = np.arange(len(keys)), np.fromiter(entries.values(), np.int32, len(entries))
        slot = self._slot(keys)
        while len(left):  # one of those that want a free slot takes it, the others go on to the next
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.values[slot[free]] = keys[left[free]], value[left[free]]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_STRIDES[0])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs' values; -1 for pairs that the table lacks and for negative numbers."""
        keys = a.astype(np.int64) << 20 | b.astype(np.int64)  # negative if one of them is, and then in no slot
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where((held == keys) & (keys >= 0), self.values[slot], np.int32(-1))
        at = np.flatnonzero((held != keys) & (held != -1))
        while len(at):
            slot_at = (slot[at] + 1) & ((1 << self.bits) - 1)
            slot[at], held = slot_at, self.keys[slot_at]
            same = (held == keys[at]) & (held >= 0)
            out[at[same]] = self.values[slot_at[same]]
            at = at[~same & (held != -1)]
        return out


@dataclass(frozen=True)
class Pieces:
    """ids: piece to (id, score). raw: each id's bytes. byte: ids of the 256 byte pieces. prefix: a space is put first."""

    ids: dict[str, tuple[int, float]]
    raw: tuple[bytes, ...]
    byte: tuple[int, ...]
    prefix: bool
    #: Symbols are piece ids, and numbers beyond them for characters that occur in pieces only. symbol: of each code point, or -1.
    symbol: np.ndarray = field(repr=False)
    #: Two symbols to the piece that they make; two symbols of characters that stand side by side in some piece.
    merged: PairTable = field(repr=False)
    beside: PairTable = field(repr=False)
    #: Each piece's place in the order in which merges are made (by falling score; equal scores share one).
    rank: np.ndarray = field(repr=False)


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    ids, raw, byte = {}, [], [0] * 256
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            ids[piece] = (i, sp.get_score(i))
            raw.append(piece.replace(SPACE, " ").encode())
    if not any(byte):
        raise ValueError("the model has no byte pieces: texts could not be decoded without loss")
    number = {p: i for p, (i, _) in ids.items()}
    for c in sorted({c for p in ids for c in p} - set(number)):
        number[c] = size + len(number)
    if max(number.values()) >= 1 << 20:
        raise ValueError("the model has more than a million symbols")
    symbol = np.full(0x110000, -1, np.int32)
    for c, i in number.items():
        if len(c) == 1:
            symbol[ord(" " if c == SPACE else c)] = i
    merged = {(number[p[:k]], number[p[k:]]): i for p, (i, _) in ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
    beside = {(number[a], number[b]): 1 for p in ids for a, b in zip(p, p[1:])}
    places = {score: i for i, score in enumerate(sorted({score for _, score in ids.values()}, reverse=True))}
    if len(places) >= 1 << 24:
        raise ValueError("the model has too many different scores")
    rank = np.full(size, -1, np.int32)
    for i, score in ids.values():
        rank[i] = places[score]
    return Pieces(ids, tuple(raw), tuple(byte), len(sp.encode("a", out_type=str)[0]) == 2, symbol, PairTable(merged), PairTable(beside), rank)


def document_key(seed: int, key: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(key.encode("utf-8", "surrogatepass"), key=str(seed).encode(), digest_size=8).digest(), "little"))


def draws(keys: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number below 2**32 for each candidate: keys of the documents, and the candidate's places in them."""
    x = keys.copy()
    for place, stride in zip((left, middle, right), _STRIDES, strict=True):
        x ^= mix(place.astype(np.uint64) * np.uint64(stride))
    return mix(x) >> np.uint64(32)


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, model: Pieces, dropout: float = DROPOUT, seed: int = SEED):
        self.model, self.limit, self.seed = model, np.uint64(round(dropout * (1 << 32))), seed
        self.byte = np.array(model.byte, np.uint32)

    def encode(self, texts: list[str], keys: list[str]) -> list[bytes]:
        """Each text's ids. keys: of the documents, for their draws."""
        out: list[list[bytes]] = [[] for _ in texts]
        group, size = [], 0
        for i, text in enumerate(texts):
            for at, span in self._spans(text):
                if size and size + len(span) > SPAN:
                    self._encode(group, out)
                    group, size = [], 0
                group.append((i, document_key(self.seed, keys[i]), at, span))
                size += len(span)
        if group:
            self._encode(group, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _spans(self, text: str) -> Iterator[tuple[int, str]]:
        """(place, part) of the text with its prefix: parts of about SPAN characters that end between chunks."""
        if not text:
            return
        text = " " + text if self.model.prefix else text
        at = 0
        while at < len(text):
            size = SPAN
            while True:
                part = text[at : at + size]
                if at + size >= len(text):
                    break
                symbols = self._symbols(part)[1]
                ends = np.flatnonzero(self.model.beside(symbols[:-1], symbols[1:]) < 0)
                if len(ends):
                    part = part[: ends[-1] + 1]
                    break
                size *= 2
            yield at, part
            at += len(part)

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return points, self.model.symbol[points]

    def _kept(self, value: np.ndarray, doc: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The candidates' ranks; NONE where there is no piece or the draw skips it."""
        rank = np.full(len(value), NONE, np.int32)
        at = np.flatnonzero(value >= 0)
        if self.limit and len(at):
            base = self.base[doc[at]]
            at = at[draws(self.key[doc[at]], left[at] - base, middle[at] - base, right[at] - base) >= self.limit]
        rank[at] = self.model.rank[value[at]]
        return rank

    def _encode(self, group: list[tuple[int, np.uint64, int, str]], out: list[list[bytes]]) -> None:
        model = self.model
        self.key = np.array([k for _, k, _, _ in group], np.uint64)
        bounds = np.cumsum([0] + [len(x) for *_, x in group])
        self.base = bounds[:-1] - np.array([at for _, _, at, _ in group])  # place in the batch less place in the text
        points, symbols = self._symbols("".join(x for *_, x in group))
        n = len(symbols)
        doc = np.repeat(np.arange(len(group)), np.diff(bounds))
        begins = np.ones(n, bool)
        begins[1:] = model.beside(symbols[:-1], symbols[1:]) < 0
        begins[bounds[:-1]] = True
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, n))
        found = symbols.copy()  # the symbol that begins at each place, -2 where none does
        for a, b in zip(first[size > STEPPED].tolist(), (first + size)[size > STEPPED].tolist()):
            self._heaped(found, doc, a, b)
        chosen = (size > 1) & (size <= STEPPED)
        self._stepped(found, doc, first[chosen], size[chosen])

        at = np.flatnonzero(found != -2)
        ids, of = found[at].astype(np.uint32), doc[at]
        odd = np.flatnonzero((found[at] < 0) | (found[at] >= len(model.raw)))
        if len(odd):  # byte pieces
            point, which = np.unique(points[at[odd]], return_inverse=True)
            spelled = [self.byte[np.frombuffer(chr(p).encode("utf-8", "surrogatepass"), np.uint8)] for p in point]
            many = np.ones(len(at), np.int64)
            many[odd] = np.array([len(x) for x in spelled])[which]
            where = np.cumsum(many) - many
            ids, of = np.repeat(ids, many), np.repeat(of, many)
            for k in range(4):
                more = odd[many[odd] > k]
                ids[where[more] + k] = np.array([x[k] if k < len(x) else 0 for x in spelled], np.uint32)[which[many[odd] > k]]
        cuts = np.searchsorted(of, np.arange(len(group) + 1))
        data = ids.astype("<u4").tobytes()
        for (i, *_), a, b in zip(group, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[i].append(data[4 * a : 4 * b])

    def _stepped(self, found: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Merges all chunks (their first places and sizes), one merge of each at a time."""
        model = self.model
        if not len(first):
            return
        heads = np.cumsum(size) - size
        place = np.repeat(first - heads, size) + np.arange(size.sum())
        symbol = found[place]
        last = np.zeros(len(place), bool)
        last[heads + size - 1] = True
        value = np.full(len(place), -1, np.int32)
        pair = np.flatnonzero(~last)
        value[pair] = model.merged(symbol[pair], symbol[pair + 1])
        after = np.append(place[1:], 0)  # where the neighbour begins, and where it ends
        after[last] = place[last] + 1
        beyond = np.append(after[1:], 0)
        offset = place - np.repeat(first, size)
        rank = self._kept(value, doc[place], place, after, beyond).astype(np.int64) * STEPPED + offset
        stop = first + size  # of each chunk
        none = np.int64(NONE) * STEPPED
        while True:
            best = np.minimum.reduceat(rank, heads)
            active = best < none
            if not active.all():
                keep = np.repeat(active, size)
                place, symbol, value, rank = place[keep], symbol[keep], value[keep], rank[keep]
                first, size, stop, best = first[active], size[active], stop[active], best[active]
                if not len(first):
                    return
                heads = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(best, size))  # one in each chunk
            symbol[at] = value[at]
            found[place[at]], found[place[at + 1]] = symbol[at], -2
            keep = np.ones(len(place), bool)
            keep[at + 1] = False
            place, symbol, value, rank = place[keep], symbol[keep], value[keep], rank[keep]
            at -= np.arange(len(at))
            size = size - 1
            heads = np.cumsum(size) - size
            tail = heads + size - 1
            # the merged symbol with its right neighbour, and its left neighbour with it
            value[at], rank[at] = -1, none
            for left, of in ((at, at < tail), (at - 1, at > heads)):
                left, chunk = left[of], np.flatnonzero(of)
                if not len(left):
                    continue
                made = model.merged(symbol[left], symbol[left + 1])
                ends = np.where(left + 1 == tail[chunk], stop[chunk], place[np.minimum(left + 2, len(place) - 1)])
                value[left] = made
                rank[left] = self._kept(made, doc[place[left]], place[left], place[left + 1], ends).astype(np.int64) * STEPPED + (place[left] - first[chunk])
                rank[left[rank[left] >= none]] = none

    def _heaped(self, found: np.ndarray, doc: np.ndarray, a: int, b: int) -> None:
        """The same for one long chunk with a heap."""
        n, symbol, base = b - a, found[a:b].tolist(), a - int(self.base[doc[a]])
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that begins at i; end 0 marks a symbol that is gone
        merged, rank = self.model.merged, self.model.rank
        key = self.key[doc[a] : doc[a] + 1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: list[int]) -> list[tuple[int, int, int, int, int]]:
            middle = [end[i] for i in left]
            right = [end[i] for i in middle]
            value = merged(np.array([symbol[i] for i in left], np.int32), np.array([symbol[i] for i in middle], np.int32))
            places = [np.array(x, np.int64) + base for x in (left, middle, right)]
            ok = (value >= 0) & (draws(np.repeat(key, len(left)), *places) >= self.limit)
            return [(int(rank[v]), i, j, k, int(v)) for v, i, j, k, good in zip(value.tolist(), left, middle, right, ok.tolist()) if good]

        agenda = offer(list(range(n - 1)))
        heapify(agenda)
        while agenda:
            _, left, right, stop, value = heappop(agenda)
            if end[left] != right or end[right] != stop:
                continue  # one of them has been merged meanwhile
            end[left], end[right], symbol[left] = stop, 0, value
            found[a + left], found[a + right] = value, -2
            if stop < n:
                before[stop] = left
            for item in offer(([before[left]] if left > 0 else []) + ([left] if stop < n else [])) if left > 0 or stop < n else []:
                heappush(agenda, item)


class Decoder:
    def __init__(self, model: Pieces):
        self.prefix = model.prefix
        self.bytes = np.frombuffer(b"".join(model.raw), np.uint8)
        self.size = np.array([len(x) for x in model.raw], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def decode(self, ids: bytes) -> str:
        out = []
        numbers = np.frombuffer(ids, "<u4")
        for a in range(0, len(numbers), SPAN):
            part = numbers[a : a + SPAN]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.bytes[np.repeat(self.at[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        data = b"".join(out)
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "surrogatepass")


def decode(model: Pieces, ids: bytes) -> str:
    return Decoder(model).decode(ids)


def _encoded(encoder: Encoder, texts: pd.Series, keys: pd.Series) -> list[bytes | None]:
    known = [i for i, t in enumerate(texts) if isinstance(t, str)]
    out: list[bytes | None] = [None] * len(texts)
    for i, ids in zip(known, encoder.encode([texts.iloc[i] for i in known], [k if isinstance(k := keys.iloc[i], str) else "" for i in known]), strict=True):
        out[i] = ids
    return out


def encode_pieces(df: DataFrame, model: Pieces, text: str = "text", key: str = "doc_id", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Adds ids (binary) and n_pieces (long)."""

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = Encoder(model, dropout, seed)
        for texts, keys in batches:
            yield pd.Series(_encoded(encoder, texts, keys), dtype=object)

    out = df.withColumn("ids", encoded(F.col(text), F.col(key).cast("string")))
    return out.withColumn("n_pieces", (F.length("ids") / 4).cast("long"))


def decode_pieces(df: DataFrame, model: Pieces, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the texts that the ids stand for."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(model)
        for batch in batches:
            yield pd.Series([decoder.decode(x) if isinstance(x, bytes) else None for x in batch], dtype=object)

    return df.withColumn(name, decoded(F.col(ids)))


def round_trip(df: DataFrame, model: Pieces, text: str = "text", key: str = "doc_id", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """Adds ids, n_pieces and decoded: encoding, then decoding of the stored numbers, in one Python stage (texts go there once)."""

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder, decoder = Encoder(model, dropout, seed), Decoder(model)
        for texts, keys in batches:
            ids = _encoded(encoder, texts, keys)
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([None if x is None else decoder.decode(x) for x in ids], dtype=object)})

    out = df.withColumn("_both", both(F.col(text), F.col(key).cast("string")))
    return out.withColumns({"ids": F.col("_both.ids"), "n_pieces": (F.length("_both.ids") / 4).cast("long"), "decoded": F.col("_both.decoded")}).drop("_both")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """model: the model file; else the session's ``spark.netquarry.pieces.model``, else MODEL."""
    path = model or spark.conf.get("spark.netquarry.pieces.model", None) or MODEL
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), load(path))
    return out.select("doc_id", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))
