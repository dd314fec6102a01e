"""Byte-level BPE encoding and decoding in padded numpy matrices.

Distinct pieces of a batch are put into matrices by length. In each round every row merges
its leftmost pair of least rank; ranks of neighbours come from an open-addressing hash table
of pairs, and rows without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm import _common as C

_NONE = np.int32(2**31 - 1)
#: Marks that the split pattern takes alone after a word.
_MARKS = frozenset(".,;:!?")
_WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)


class PairTable:
    """(left id, right id) -> rank, by linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(rank))))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, rest, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(rest):
            self.probes += 1
            at = (slot[rest] + self.probes - 1) & self.mask
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.ranks[at[won]] = key[rest[won]], rank[rest[won]]
            rest = np.delete(rest, won)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; _NONE where the pair isn't there or an id is negative."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        shape, key = key.shape, key.ravel()
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], _NONE)
        rest = np.flatnonzero((found != key) & (found != -1) & (key >= 0))
        for probe in range(1, self.probes):
            if not len(rest):
                break
            at = (self._slot(key[rest]) + probe) & self.mask
            found = self.keys[at]
            hit = found == key[rest]
            out[rest[hit]] = self.ranks[at[hit]]
            rest = rest[~hit & (found != -1)]
        return out.reshape(shape)


def _visible_bytes() -> dict[str, int]:
    """The characters that stand for bytes in JSON vocabularies: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBPE:
    """A vocabulary of byte strings whose ids are ranks, the pairs that merge, and a pattern that splits text.

    A piece that is itself in the vocabulary is that id; ``limit`` bounds the pieces remembered.
    """

    def __init__(self, vocab: dict[bytes, int], pairs: list[tuple[int, int, int]], pattern: str, limit: int = 200_000):
        import regex

        self.vocab, self.limit = vocab, limit
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in vocab.items()}
        self.pairs = PairTable(*(np.array(x, np.int32) for x in (zip(*pairs) if pairs else ((), (), ()))))
        self.byte_id = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.mark_ids = {m: vocab[m.encode()].to_bytes(4, "little") for m in _MARKS}

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> ByteBPE:
        """From a rank file: any two neighbours whose bytes together are in the vocabulary merge."""
        with open(path, "rb") as f:
            vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().split(b"\n")))}
        pairs = [(vocab[t[:k]], vocab[t[k:]], r) for t, r in vocab.items() for k in range(1, len(t)) if t[:k] in vocab and t[k:] in vocab]
        return cls(vocab, pairs, pattern)

    @classmethod
    def from_json(cls, path: str, pattern: str) -> ByteBPE:
        """From a JSON vocabulary with a list of merges, whose ids follow the merges' order."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _visible_bytes()
        as_bytes = lambda token: bytes(byte[c] for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in byte for c in t) and (len(t) == 1 or not t.startswith("<|"))}
        pairs = [(vocab[as_bytes(a)], vocab[as_bytes(b)], vocab[as_bytes(a + b)]) for a, b in merges]
        if any(x[2] >= y[2] for x, y in zip(pairs, pairs[1:])):
            raise ValueError("ids don't follow the order of merges")
        return cls(vocab, pairs, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece, merged apart from the others."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.vocab.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > _WIDTHS[-1]:
                out[k] = self._encode_long(piece)
            else:
                by_width.setdefault(_WIDTHS[bisect.bisect_left(_WIDTHS, len(piece))], []).append(k)
        for width, rows in by_width.items():
            step = max(1, 1_000_000 // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for k, ids in zip(part, self._encode_matrix([pieces[k] for k in part], width)):
                    out[k] = ids
        return out

    def _encode_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(width) < size[:, None]
        tokens = np.full((n, width), -1, np.int32)
        tokens[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = self.pairs.get(tokens[:, :-1], tokens[:, 1:])
        row, out = np.arange(n), [None] * n
        while len(row):
            at = ranks.argmin(1)
            every = np.arange(len(row))
            best = ranks[every, at]
            live = best != _NONE
            if not live.all():
                done = ~live
                flat = tokens[done][np.arange(tokens.shape[1]) < size[done][:, None]].astype("<u4").tobytes()
                ends = (4 * np.cumsum(size[done])).tolist()
                for r, a, b in zip(row[done].tolist(), [0, *ends], ends):
                    out[r] = flat[a:b]
                row, tokens, ranks, size, at, best = (x[live] for x in (row, tokens, ranks, size, at, best))
                if not len(row):
                    break
                every = np.arange(len(row))
            tokens[every, at] = best
            width = int(size.max()) - 1
            size -= 1
            column = np.arange(width)
            source = column + (column > at[:, None])
            tokens = np.take_along_axis(tokens, source, 1)
            tokens[column >= size[:, None]] = -1
            ranks = np.take_along_axis(ranks, source, 1)
            right = np.where(at + 1 < size, tokens[every, np.minimum(at + 1, width - 1)], -1)
            ranks[every, at] = self.pairs.get(best, right)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.get(tokens[left, at[left] - 1], best[left])
            ranks[column >= size[:, None]] = _NONE
        return out

    def _encode_long(self, piece: bytes) -> bytes:
        """The same merges for one very long piece, by a heap over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.get(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.pairs.get(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))[0])
            if r != _NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk.

        The commonest forms (a word, a word and a mark) are seen at a glance; the pattern splits the others.
        """
        if len(self.known) > self.limit:
            self.known.clear()
        known, marks = self.known, self.mark_ids
        out: list = [None] * len(chunks)
        todo, pieces, tails, odd = [], [], [], []
        for k, chunk in enumerate(chunks):
            word = chunk[1:] if chunk[:1] == " " else chunk
            if word.isalpha():
                piece, tail = chunk, b""
            elif word[-1:] in marks and word[:-1].isalpha():
                piece, tail = chunk[:-1], marks[word[-1]]
            else:
                odd.append(k)
                continue
            got = known.get(piece)
            if got is not None:
                out[k] = got + tail
            else:
                todo.append(k)
                pieces.append(piece)
                tails.append(tail)
        made = self.encode_pieces([p.encode() for p in pieces])
        known.update(zip(pieces, made))
        for k, ids, tail in zip(todo, made, tails):
            out[k] = ids + tail
        if odd:
            split = [self.split(chunks[k]) for k in odd]
            new = list({p for parts in split for p in parts}.difference(known))
            known.update(zip(new, self.encode_pieces([p.encode() for p in new])))
            for k, parts in zip(odd, split):
                out[k] = b"".join(map(known.__getitem__, parts))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Codec:
    def __init__(self, path: str, pattern: str):
        self.bpe = ByteBPE.from_ranks(path, pattern)
        self.cache = C.ChunkCache(self.bpe.encode_chunks)


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of ``docs`` (doc_id, text).

    ``ids`` are little-endian unsigned 32-bit ids, ``decoded`` the bytes they stand for. With
    ``digests`` the two are replaced by their SHA-256. Null and empty texts have no ids.
    Repeated rows give repeated results; other columns are ignored.
    """
    C.small_batches(docs.sparkSession)

    def run(batches):
        codec = C.worker_cache(_Codec, path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = codec.cache.ids(texts)
            decoded = list(map(codec.bpe.decode, ids))
            counts = [len(x) // 4 for x in ids]
            if digests:
                ids, decoded = ([hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, decoded))
            kind = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(decoded, kind)], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kind = "string" if digests else "binary"
    return C.pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} {kind}, {names[3]} {kind}")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded; see ``encode_documents``."""
    import public_tokenizers

    return encode_documents(C.table(spark, sf_dir, "documents"), C.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
