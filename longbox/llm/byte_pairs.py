"""Token ids of whole texts by the tokenizers library, with ids kept by chunk.

The byte-level pattern never joins a space, or a line's end, and the non-space after it to what stands before, nor a
letter or digit to a full stop or comma after it.  A text may be cut there without changing an id.  Texts of a batch are
cut, and their chunks numbered, as whole arrays.  The library encodes chunks that are new many at a time, with line's
ends between, then they are looked up; the store is emptied when it outgrows its bytes, so that a worker's memory stays
bounded.  Texts with white space of any other shape, or with the string of an added token, go to the library whole.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from longbox.llm.shared import STORE_BYTES, Store

#: Rows and bytes of a slice of texts.  The store is indexed once a slice; arrays and lists take many times a slice's bytes.
ENCODE_ROWS = 2500
ENCODE_BYTES = 2 << 20
#: New chunks that the library is given at a time.
LEARN_CHUNKS = 256
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: White space other than single spaces and line ends between non-spaces; U+0001 marks cuts.
_ODD_SPACE = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x{01}\t\r\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A stop or comma that does not follow a letter or digit: such a text is cut at spaces and line ends alone.
_ODD_STOP = rf"(^|[^{_LETTER}0-9])[.,]"
_WORD = rf"^\n?[{_LETTER}]+$"


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def _byte_letters() -> list[str]:
    """The printable letter of each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def _runs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``values[s : s + c]`` for each start and count, one run after another."""
    ends = np.cumsum(counts)
    kind = np.int32 if len(values) + int(counts.sum()) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + counts).astype(kind), counts)
    at += np.arange(len(at), dtype=kind)
    return values[at]


class ChunkEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does; ids are little-endian uint32 bytes."""

    def __init__(self, path: str, most_bytes: int = STORE_BYTES // 4):
        self.tokenizer = Tokenizer.from_file(path)
        letters = _byte_letters()
        # The pattern leaves a word of letters, with its space if any, whole: the model may see it at once.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(letters[ord("\n")])
        self.letters = dict(enumerate(letters))
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.store = Store(most_bytes)

    def _library(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, chunks: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one chunk after another, and the number of each chunk's.

        A chunk that starts with U+0001 stands without a space, one with a line's end as it is.
        """
        ids, sizes = [], []
        for start in range(0, len(chunks), LEARN_CHUNKS):
            some = chunks.slice(start, LEARN_CHUNKS).to_pylist()
            text = ("\n " + "\n ".join(some)).replace("\n \x01", "\n").replace("\n \n", "\n")
            if words:
                coded = self.words.encode(text[1:].encode().decode("latin-1").translate(self.letters), add_special_tokens=False)
                sizes.append(np.bincount(coded.word_ids, minlength=len(some)))
            else:
                coded = self.tokenizer.encode(text, add_special_tokens=False)
            ids.append(np.array(coded.ids, np.uint32))
        found = np.concatenate(ids)
        if words:
            counts = np.concatenate(sizes)
        else:
            is_end = found == self.line_end
            counts = np.diff(np.flatnonzero(is_end), append=len(found)) - 1
            found = found[~is_end]
        if len(counts) != len(chunks):
            raise ValueError("the vocabulary's pattern does not leave line's ends alone")
        line = pc.starts_with(chunks, "\n").to_numpy(zero_copy_only=False)
        return np.insert(found, (np.cumsum(counts) - counts)[line], self.line_end), counts + line

    def _known(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the store, and where those of each chunk start in them, and their number; new chunks are learned.

        Of a store that outgrew its bytes, what was met again since it last did stays.
        """
        none = pa.array([], chunks.type), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)
        stored, ids, counts, met = self.store.open().get("chunks", none)
        place = pc.index_in(chunks, value_set=stored)
        is_new = place.is_null().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(is_new)
        place = place.fill_null(0).to_numpy().astype(np.int64)
        met[place[~is_new]] = True
        if len(rows):
            if self.store.bytes > self.store.most_bytes // 2:
                kept = np.flatnonzero(met)
                starts, counts = (np.cumsum(counts) - counts)[kept], counts[kept]
                stored, ids = stored.take(pa.array(kept)), _runs(ids, starts, counts)
                if len(kept):
                    place = (np.cumsum(met) - 1)[place]
                met = np.zeros(len(kept), bool)
            is_word = pc.match_substring_regex(chunks.take(pa.array(rows)), _WORD).to_numpy(zero_copy_only=False)
            for some, words in ((rows[is_word], True), (rows[~is_word], False)):
                if len(some):
                    part = chunks.take(pa.array(some))
                    place[some] = np.arange(len(stored), len(stored) + len(some))
                    more_ids, more_counts = self._learn(part, words)
                    stored, ids, counts = pa.concat_arrays([stored, part]), np.concatenate([ids, more_ids]), np.concatenate([counts, more_counts])
            met = np.concatenate([met, np.zeros(len(rows), bool)])
            self.store.clear()
            self.store.keep("chunks", (stored, ids, counts, met), stored.nbytes + ids.nbytes + counts.nbytes + met.nbytes)
        return ids, (np.cumsum(counts) - counts)[place], counts[place]

    def _encode_cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that may be cut."""
        # A line's end before the text lets its first chunk count as a line's first; that token is left out again.
        start, between = pa.scalar("\n", texts.type), pa.scalar("", texts.type)
        cut = pc.binary_join_element_wise(start, pc.replace_substring(texts, "\n", " \n"), between)
        stops = pc.replace_substring(pc.replace_substring(cut, ".", " \x01."), ",", " \x01,")
        chunks = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _ODD_STOP), cut, stops), " ")
        edges = chunks.offsets.to_numpy()
        coded = chunks.flatten().dictionary_encode()
        ids, starts, counts = self._known(coded.dictionary)
        nth = coded.indices.to_numpy()
        starts, counts = starts[nth], counts[nth]
        starts[edges[:-1]] += 1
        counts[edges[:-1]] -= 1
        found, stops = memoryview(_runs(ids, starts, counts).astype("<u4", copy=False)).cast("B"), np.cumsum(counts)[edges[1:] - 1] * 4
        return [bytes(found[a:b]) for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def encode_bytes(self, column: pa.Array) -> list[bytes]:
        """Ids of each text, as bytes of little-endian uint32.  Null and empty texts give none."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _ODD_SPACE)
        for special in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        cut = pc.and_not(pc.not_equal(texts, ""), whole)
        out = [b""] * len(texts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = self._library(texts[k].as_py())
        rows = np.flatnonzero(cut).tolist()
        if rows:
            for k, ids in zip(rows, self._encode_cut(texts.filter(cut)), strict=True):
                out[k] = ids
        return out


@cache
def encoder(path: str) -> ChunkEncoder:
    """One encoder a Python worker."""
    return ChunkEncoder(path)
