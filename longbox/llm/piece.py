"""SentencePiece encoding and decoding with offsets.

A text is normalised by the model's compiled character map: at each place the longest key that starts there is
replaced, and every normalised byte keeps the source byte it came from.  The normalised text is segmented by the
model's byte-pair pieces and each piece is projected through that alignment to a span of source bytes.

No piece joins a space mark to a character before it, so pieces are found by space-led chunk and kept; a model with
such pieces is segmented whole.  Null and empty texts have no ids, decode to the empty text and have no spans.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.llm.shared import Store, map_batches, texts_of

MARK = "▁".encode()
_NONE = float("inf")
#: Record of a piece in a chunk: id, bytes as normalised, bytes in a source whose spaces marks stand for.
_RECORD = struct.Struct("<IHH")
_PIECES = np.dtype([("id", "<u4"), ("normal", "<u2"), ("plain", "<u2")])
_RUN = re.compile(rb"(?:\xe2\x96\x81)+(?:(?!\xe2\x96\x81).)*|(?:(?!\xe2\x96\x81).)+", re.DOTALL)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """Compiled character map: a double-array trie of source strings and a block of NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        if not self.units:
            return None
        unit, node, best = self.units[0], 0, None
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return best


class PieceModel:
    """Pieces, scores and normalisation of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only byte-pair models are supported")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("suffix marks, user-defined and unused pieces are not supported")
        self.pieces = [p.piece.encode() for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.cost = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.number = {p.piece: _RECORD.pack(i, len(p.piece.encode()), len(p.piece.encode()) - 2 * p.piece.count("▁")) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.surface = [p if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " for p, k in zip(self.pieces, self.kind, strict=True)]
        self.surface = [s.replace(MARK, b" ") if k == NORMAL else s for s, k in zip(self.surface, self.kind, strict=True)]
        self.chunked = not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kind, strict=True) if k == NORMAL and p.startswith(MARK)) and not any(MARK in p for p, k in zip(self.pieces, self.kind, strict=True) if k == NORMAL and not p.startswith(MARK))
        self.lines = not any(b"\n" in p for p in self.pieces)  # no piece goes over a line's end
        self.store = Store()

    # Normalisation -----------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[bytes, np.ndarray | None]:
        """Normalised bytes and, for each of them and the end, the source byte; None if they differ by marks alone."""
        if not text:
            return b"", None
        source = text.encode()
        if not self.map.units and not self.squeeze and "▁" not in text:
            out = source.replace(b" ", MARK) if self.escape else source
            return (MARK if self.escape else b" ") + out if self.dummy_prefix else out, None
        return self._by_map(source)

    def _by_map(self, source: bytes) -> tuple[bytes, np.ndarray]:
        space = MARK if self.escape else b" "
        out, at, i, last_space = bytearray(), [], 0, self.squeeze
        if self.dummy_prefix:
            out += space
            at += [0] * len(space)
        while i < len(source):
            hit = self.map.longest(source, i)
            if hit:
                taken, new = hit
            else:
                lead = source[i]
                taken = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = source[i : i + taken]
            for c in re.findall(rb" |[^ ]+", new):
                if c == b" " and self.squeeze and last_space:
                    continue
                piece = space if c == b" " else c
                out += piece
                at += [i] * len(piece)
                last_space = c == b" "
            i += taken
        end = len(source)
        while self.squeeze and out.endswith(space) and len(out) > (len(space) if self.dummy_prefix else 0):
            end = at[-1]
            del out[-len(space) :], at[-len(space) :]
        if self.squeeze and self.dummy_prefix and bytes(out) == space:
            return b"", np.zeros(1, np.int64)
        return bytes(out), np.array([*at, end], np.int64)

    # Segmentation ------------------------------------------------------------------------------------------

    def _merge(self, chunk: bytes) -> list[str]:
        """Pieces of a chunk: the adjacent pair of best score is joined first, the leftmost among equals."""
        cost, none = self.cost.get, _NONE
        parts = list(chunk.decode())
        if len(parts) <= 40:
            pairs = [cost(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            while pairs:
                best = min(pairs)
                if best == none:
                    break
                i = pairs.index(best)
                joined = parts[i] = parts[i] + parts.pop(i + 1)
                del pairs[i]
                if i:
                    pairs[i - 1] = cost(parts[i - 1] + joined, none)
                if i < len(pairs):
                    pairs[i] = cost(joined + parts[i + 1], none)
            return parts
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := cost(parts[i] + parts[j], none)) != none:
                heapq.heappush(heap, (r, i, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _chunk(self, chunk: bytes) -> bytes:
        """A record for each piece of a chunk: its id, its bytes as normalised, and as in a source whose spaces marks stand for."""
        parts = self._merge(chunk)
        try:
            return b"".join([self.number[p] for p in parts])
        except KeyError:
            return b"".join([self.number[p] if p in self.number else self._unseen(p.encode()) for p in parts])

    def _unseen(self, p: bytes) -> bytes:
        """A character that has no piece: its bytes share its span, the first has it whole."""
        ids = [self.byte_id[b] for b in p] if self.byte_id else [self.unknown]
        return b"".join([_RECORD.pack(i, 0 if k else len(p), 0 if k else 1 if p == MARK else len(p)) for k, i in enumerate(ids)])

    def _chunks(self, normal: bytes) -> list[bytes]:
        if not normal:
            return []
        if not self.chunked:
            return [self._chunk(normal)]
        if MARK + MARK in normal or not normal.startswith(MARK):
            return [self._chunk(p) for p in _RUN.findall(normal)]
        parts = (normal.replace(b"\n", MARK + b"\n") if self.lines else normal)[len(MARK) :].split(MARK)
        known = self.store.open()
        found = list(map(known.get, parts))
        if None in found:
            for k, p in enumerate(parts):
                if found[k] is None:
                    chunk = known.get(p) or self._chunk(p if self.lines and p.startswith(b"\n") else MARK + p)
                    found[k] = self.store.keep(p, chunk, len(p) + len(chunk))
        return found

    # Whole texts -------------------------------------------------------------------------------------------

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and a row of source byte start and end for each; the added leading mark takes no byte."""
        ids, starts, ends = self.encode_spans(text)
        return ids, np.stack([starts, ends], 1)

    def encode_spans(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and source byte starts and ends of their pieces."""
        normal, at = self.normalise(text)
        pieces = np.frombuffer(b"".join(self._chunks(normal)), _PIECES)
        if not len(pieces):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = pieces["normal"].astype(np.int64)
        if at is None:  # marks are spaces, and the added one is no source byte
            sizes = pieces["plain"].astype(np.int64)
            sizes[0] -= self.dummy_prefix
            ends = np.cumsum(sizes)
            starts = ends - sizes
        else:
            ends = np.cumsum(lengths)
            starts, ends = at[ends - lengths], at[ends]
        if not lengths.all():
            for k in np.flatnonzero(lengths == 0):  # further bytes of a character that has no piece
                starts[k], ends[k] = starts[k - 1], ends[k - 1]
        return pieces["id"].tolist(), starts, ends

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the added one goes, byte pieces join, and bytes that form no character become U+FFFD one by one."""
        kind = self.kind
        out = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if kind[i] != CONTROL), None)
        if self.dummy_prefix and first is not None and kind[first] == NORMAL and out.startswith(b" "):
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._decode_loose(ids)

    def _decode_loose(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            rest = bytes(run)
            while rest:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(rest[:n].decode())
                        rest = rest[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    rest = rest[1:]
            run.clear()

        for k, i in enumerate(ids):
            if self.kind[i] == BYTE:
                run += self.surface[i]
                continue
            flush()
            s = self.surface[i].decode()
            out.append(s[1:] if k == 0 and self.dummy_prefix and s.startswith(" ") else s)
        flush()
        return "".join(out)


@cache
def model(path: str) -> PieceModel:
    """One model a Python worker."""
    return PieceModel(path)


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, starts array<int>, ends array<int>)``: ids of each whole text with source byte spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        done = [m.encode(t) for t in texts_of(batch, 1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([d[0] for d in done], pa.list_(pa.int32())), pa.array([d[1][:, 0] for d in done], pa.list_(pa.int32())), pa.array([d[1][:, 1] for d in done], pa.list_(pa.int32()))],
            ["doc_id", "ids", "starts", "ends"],
        )

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of a table with ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ids and of the decoded text of each whole text.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes``; the last is the number of source bytes that
    the pieces' spans cover.  One pass, no shuffle; only digests leave the worker.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        n, a, b, covered = [], [], [], []
        for text in texts_of(batch, 1):
            ids, _, ends = m.encode_spans(text)
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
            covered.append(int(ends[-1]) if ids else 0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(covered, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
