"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text becomes characters (spaces as U+2581, one put in front) whose neighbours
merge, best score first and leftmost among equals, while their concatenation is a
piece.  With dropout, a candidate merge is skipped for good if the hash of (seed,
text key, start, middle and end of the candidate) falls below the rate: the same
seed gives the same segmentation on any machine, another seed or text another
one.  Characters without a piece become bytes, and so does a U+2581 of the text
itself, so decoding returns every text exactly.

No merge crosses the start of a word (spaces, then other characters), so words
merge independently: all short words of a chunk take their next merge together
in numpy, and a longer one (``LONG`` symbols) runs an agenda of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefsight.llm import kernels as K

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
SEED = 17
LONG = 64
_SPACE = 0x2581
_NONE = np.int32(2**31 - 1)
#: Small enough for the arrays of a chunk to stay in the cache.
_CHUNK = 1 << 16


class Pieces:
    """Tables of a merge-type model: characters, merges, piece bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.first_byte = next(i for i in range(n) if sp.is_byte(i))
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        symbol = {names[i]: i for i in normal}
        for i in normal:  # characters that are only parts of pieces
            for ch in names[i]:
                symbol.setdefault(ch, len(symbol) + n)
        if any("▁" in names[i].lstrip("▁") for i in normal):
            raise ValueError("pieces that cross the start of a word are not supported")
        self.n_pieces = n
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        scores = np.array([sp.get_score(i) for i in normal])
        rank = dict(zip(normal, (np.unique(-scores, return_inverse=True)[1]).tolist(), strict=True))
        keys, ranks, merged = [], [], []
        for i in normal:
            for cut in range(1, len(names[i])):
                a, b = symbol.get(names[i][:cut]), symbol.get(names[i][cut:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    ranks.append(rank[i])
                    merged.append(i)
        self._hash(np.array(keys, np.uint64), np.array(ranks, np.int32), np.array(merged, np.int32))
        self.raw = [bytes([i - self.first_byte]) if sp.is_byte(i) else
                    (b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace("▁", " ").encode())
                    for i in range(n)]

    def _hash(self, keys, ranks, merged):
        """Open addressing; ``self.reach`` is the longest probe."""
        self.bits = int(np.ceil(np.log2(max(2, len(keys)) * 4)))
        size = 1 << self.bits
        self.keys = np.full(size + 64, 2**63, np.uint64)
        self.ranks = np.full(size + 64, _NONE, np.int32)
        self.merged = np.zeros(size + 64, np.int32)
        self.reach = 1
        for k, at, r, m in zip(keys.tolist(), self._slot(keys).tolist(), ranks.tolist(), merged.tolist(), strict=True):
            step = 0
            while self.keys[at + step] != 2**63:
                step += 1
            self.keys[at + step], self.ranks[at + step], self.merged[at + step] = k, r, m
            self.reach = max(self.reach, step + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; rank _NONE where there is no piece."""
        rank, merged = np.full(len(a), _NONE, np.int32), np.zeros(len(a), np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[todo].astype(np.uint64) << np.uint64(20)) | b[todo].astype(np.uint64)
        slot = self._slot(keys)
        for _ in range(self.reach):
            held = self.keys[slot]
            hit = held == keys
            rank[todo[hit]], merged[todo[hit]] = self.ranks[slot[hit]], self.merged[slot[hit]]
            more = ~hit & (held != np.uint64(2**63))
            if not more.any():
                break
            todo, keys, slot = todo[more], keys[more], slot[more] + 1
        return rank, merged


class Encoder:
    """Segments chunks of texts; ``rate`` 0 gives the model's own segmentation."""

    def __init__(self, pieces: Pieces, rate: float = RATE, seed: int = SEED):
        self.p, self.seed = pieces, seed
        self.limit = np.uint64(min(int(rate * 2.0**64), 2**64 - 1))

    def _candidates(self, left, right, key, start, middle, end):
        """(rank, merged) of candidates; skipped ones have no rank."""
        rank, merged = self.p.lookup(left, right)
        if self.limit:
            live = np.flatnonzero(rank != _NONE)
            rank[live[self._skipped(key[live], start[live], middle[live], end[live])]] = _NONE
        return rank, merged

    def _skipped(self, key, start, middle, end):
        h = K.keyed(key ^ (start.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), self.seed)
        return K.mix(h ^ (middle.astype(np.uint64) << np.uint64(32)) ^ end.astype(np.uint64)) < self.limit

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text; ``keys`` tells texts apart for the dropout."""
        lengths = np.array([len(t) + (len(t) > 0) for t in texts], np.int64)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        joined = "".join(" " + t if t else "" for t in texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(code):
            return [np.empty(0, np.int32) for _ in texts]
        space = code == 32
        symbol = self.p.char[np.where(space, _SPACE, code)]
        symbol[code == _SPACE] = -1  # its own character: bytes
        text_of = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(code)) - bounds[text_of]
        begins = space & ~np.concatenate(([False], space[:-1]))
        begins[bounds[:-1][lengths > 0]] = True
        word_at = np.flatnonzero(begins)
        word_len = np.diff(np.append(word_at, len(code)))
        key = K.keyed(keys.astype(np.uint64), 6)
        alive = np.ones(len(code), bool)

        long = np.flatnonzero(word_len > LONG)
        short = np.flatnonzero(word_len <= LONG)
        self._merge_short(word_at[short], word_len[short], symbol, place, key[text_of], alive)
        for w in long:
            a, b = word_at[w], word_at[w] + word_len[w]
            self._merge_long(a, b, symbol, place, key[text_of[a]], alive)
        return self._ids(np.flatnonzero(alive), symbol, code, bounds)

    def _merge_short(self, start, size, symbol, place, key, alive):
        """One merge per word and round, of all words that still have one.

        Symbols stay at the place of their first character and are linked; only the
        scores, rank and offset in one number, are scanned for each word's least.
        The index after the last character stands for the end of any word.
        """
        n, shift, none = len(symbol), LONG.bit_length(), int(_NONE)
        sym, where = np.append(symbol, -1), np.append(place, 1 << 31)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[start + size - 1] = after[n] = before[start] = n
        merged = np.zeros(n + 1, np.int32)

        def scores(i, offset):
            """Scores of the candidates of symbols ``i`` and those after them."""
            j = after[i]
            rank, merged[i] = self.p.lookup(sym[i], sym[j])
            ok = np.flatnonzero(rank != _NONE)
            if self.limit:
                x, y = i[ok], j[ok]
                ok = ok[~self._skipped(key[x], where[x], where[y], where[after[y]])]
            out = np.full(len(i), none, np.int64)
            out[ok] = (rank[ok].astype(np.int64) << shift) | offset[ok]
            return out
        local = np.cumsum(size) - size
        offset = np.arange(int(size.sum())) - np.repeat(local, size)
        score = scores(offset + np.repeat(start, size), offset)
        while len(start):
            least = np.minimum.reduceat(score, local)
            going = np.flatnonzero(least != none)
            if 4 * len(going) < 3 * len(start):  # finished words leave
                score = score[np.repeat(least != none, size)]
                start, size, least = start[going], size[going], least[going]
                local, going = np.cumsum(size) - size, np.arange(len(going))
            if not len(going):
                break
            base, to_local = start[going], local[going] - start[going]
            i = base + (least[going] & ((1 << shift) - 1))
            j = after[i]
            k = after[j]
            sym[i], alive[j], after[i], before[k] = merged[i], False, k, i
            score[j + to_local] = none
            left = before[i]
            has = np.flatnonzero(left < n)
            new = np.concatenate((i, left[has]))
            score[np.concatenate((i + to_local, left[has] + to_local[has]))] = scores(
                new, new - np.concatenate((base, base[has])))
        symbol[:] = sym[:n]

    def _merge_long(self, a, b, symbol, place, key, alive):
        """The agenda of one long word."""
        n = b - a
        sym = symbol[a:b].tolist()
        where = place[a:b].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        key1 = np.array([key], np.uint64)

        def candidate(i):
            j = after[i]
            if i < 0 or j >= n:
                return None
            end = where[after[j]] if after[j] < n else 1 << 31
            rank, merged = self._candidates(np.array([sym[i]]), np.array([sym[j]]), key1,
                                            np.array([where[i]]), np.array([where[j]]), np.array([end]))
            return None if rank[0] == _NONE else (int(rank[0]), i, j, after[j], int(merged[0]))
        at = np.arange(n - 1)
        end = np.append(place[a + 2:b], 1 << 31)
        rank, merged = self._candidates(symbol[a:b - 1], symbol[a + 1:b], np.full(n - 1, key), place[a:b - 1],
                                        place[a + 1:b], end)
        live = np.flatnonzero(rank != _NONE)
        agenda = [(int(r), int(i), int(i) + 1, int(i) + 2, int(m))
                  for r, i, m in zip(rank[live], at[live], merged[live], strict=True)]
        heapq.heapify(agenda)
        gone = [False] * n
        while agenda:
            _, i, j, k, m = heapq.heappop(agenda)
            if gone[i] or gone[j] or after[i] != j or after[j] != k:
                continue
            sym[i], gone[j], after[i] = m, True, k
            if k < n:
                before[k] = i
            for c in ((candidate(before[i]) if before[i] >= 0 else None), candidate(i)):
                if c:
                    heapq.heappush(agenda, c)
        symbol[a:b] = sym
        alive[a:b] = ~np.array(gone)

    def _ids(self, at, symbol, code, bounds) -> list[np.ndarray]:
        sym = symbol[at]
        ids = sym.copy()
        odd = np.flatnonzero((sym < 0) | (sym >= self.p.n_pieces))
        owner = np.searchsorted(bounds, at, side="right") - 1
        if len(odd):  # characters without a piece: their UTF-8 bytes
            raw = [chr(int(c)).encode("utf-8", "surrogatepass") for c in code[at[odd]]]
            fan = np.ones(len(at), np.int64)
            fan[odd] = [len(r) for r in raw]
            first = np.cumsum(fan) - fan
            ids, owner = np.repeat(ids, fan), np.repeat(owner, fan)
            spots = np.repeat(first[odd], fan[odd]) + np.concatenate([np.arange(len(r)) for r in raw])
            ids[spots] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + self.p.first_byte
        cut = np.searchsorted(owner, np.arange(len(bounds)))
        return [ids[cut[i]:cut[i + 1]].astype(np.int32) for i in range(len(bounds) - 1)]


def decode(pieces: Pieces, ids: list[int]) -> str:
    """The text of piece ids: their bytes without the space put in front."""
    raw = b"".join(map(pieces.raw.__getitem__, ids))
    return raw[1:].decode("utf-8", "replace") if raw else ""


_built: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """Tables of the model, made once per worker."""
    key = hash(model)
    if key not in _built:
        _built.clear()
        _built[key] = Pieces(model)
    return _built[key]


def _encode_rows(batches: Iterator[pa.RecordBatch], model: bytes, rate: float, seed: int, n_keep: int):
    pieces = _pieces(model)
    encoder = Encoder(pieces, rate, seed)
    for batch, raw in K.text_chunks(batches, "__text", _CHUNK):
        texts = [t.decode("utf-8") for t in raw]
        keys = batch.column(n_keep).to_numpy(zero_copy_only=False).view(np.uint64)
        ids = encoder.encode(texts, keys)
        same = [decode(pieces, i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(n_keep)), pa.array([len(i) for i in ids], pa.int64()),
             pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
            names=[*batch.schema.names[:n_keep], "n_pieces", "piece_ids", "lossless"])


def _decode_rows(batches, model: bytes, column: str):
    pieces = _pieces(model)
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = [None if ids is None else decode(pieces, ids) for ids in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                         names=[*batch.schema.names, "decoded"])


def read_model(path: str = MODEL) -> bytes:
    """The model file (well below a megabyte), sent to the workers with the task."""
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, *, keep: list[str], key: str = "doc_id", text: str = "text",
                  model: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """``keep`` columns of every row with n_pieces, piece_ids and lossless.

    The dropout of a text is keyed by ``seed`` and the hash of ``key``; rows that
    repeat both key and text get the same pieces, and a null key is a key like
    any other.  lossless tells whether decoding gives the text back.  A null or
    empty text has no pieces.  Texts of any length are encoded whole.  No rows
    give no rows.  Other columns are not read; result columns replace columns of
    ``keep`` with their names.
    """
    K.small_batches(docs.sparkSession)
    keep = [c for c in keep if c not in ("n_pieces", "piece_ids", "lossless")]
    rows = docs.select(*keep, F.xxhash64(F.col(key)).alias("__key"), F.col(text).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]),
                        "n_pieces bigint, piece_ids array<int>, lossless boolean"])
    return rows.mapInArrow(lambda it: _encode_rows(it, shared.value, rate, seed, len(keep)), schema)


def decode_pieces(encoded: DataFrame, *, ids: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """All columns and the text of the pieces as ``decoded``; null ids give null."""
    rows = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "decoded string"])
    return rows.mapInArrow(lambda it: _decode_rows(it, shared.value, ids), schema)
