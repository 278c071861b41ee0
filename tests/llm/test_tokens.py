"""Encoding, decoding, the token file, packing and token counts against the libraries and brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from longbox.llm import lengths, packing, piece, token_file
from longbox.llm.byte_pairs import ChunkEncoder
from longbox.llm.queries import tokenizer_path
from longbox.llm.shared import slices

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
ALPHABETS = ["ab  é▁\n\t😀\x00<s>日本'.,1   ", "ab é.,s't\ńñ 12 -\x01", "xyz .\n", "a\u00a0\u3000 b\r\n"]
SCHEMA = "doc_id long, text string, n_tokens string, ids long"


def some_texts(n: int, most: int = 40, seed: int = 5) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(rnd.choice(ALPHABETS)) if rnd.random() < 0.05 else rnd.choice(a) for _ in range(rnd.randint(0, most))) for a in ALPHABETS for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty and long texts, repeated rows, null ids, and columns whose names clash with results."""
    texts = [None, "", " ", "a" * 30_000, "word " * 9_000, *some_texts(20), "same", "same", "x <|endoftext|> y"]
    rows = [(i if i != 9 else None, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-2]], SCHEMA)


def test_pieces_equal_the_library():
    model, library = piece.PieceModel(tokenizer_path(PIECES)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    for text in [*some_texts(300), "é" * 300 + "ab" * 4000, "a\n b\n\nc"]:
        ids, spans = model.encode(text)
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids)
        # Spans tile the source: what the pieces cover, in order, is the whole text.
        source, at = text.encode(), 0
        for k, (a, b) in enumerate(spans.tolist()):
            assert (a, b) == tuple(spans[k - 1].tolist()) if k and a < at else a == at
            at = max(at, b)
        assert at == len(source)


def test_decoding_of_any_ids_equals_the_library():
    model, library = piece.PieceModel(tokenizer_path(PIECES)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    rnd = random.Random(2)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(259, 32000)]) for _ in range(rnd.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids)


def double_array(table: dict[bytes, bytes]) -> bytes:
    """Character map of a few keys: a double-array trie laid out by brute force, and the replacements."""
    strings, values = b"", {}
    for key, new in table.items():
        values[key] = len(strings)
        strings += new + b"\0"
    units, used, bases = {0: 0}, {0}, set()  # no two nodes share a base, else one would have the other's children
    nodes = [(b"", 0)]
    while nodes:
        prefix, at = nodes.pop()
        labels = sorted({k[len(prefix)] for k in table if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in table
        base = next(b for b in range(1, 1 << 20) if b not in bases and all((b ^ x) not in used for x in [*labels, *([0] if leaf else [])]))
        bases.add(base)
        units[at] = units.get(at, 0) | ((at ^ base) << 10) | (1 << 8 if leaf else 0)
        if leaf:
            used.add(base)
            units[base] = values[prefix] | 1 << 31
        for x in labels:
            used.add(base ^ x)
            units[base ^ x] = x
            nodes.append((prefix + bytes([x]), base ^ x))
    flat = np.zeros(max(units) + 256, "<u4")
    for i, u in units.items():
        flat[i] = u
    return int(flat.nbytes).to_bytes(4, "little") + flat.tobytes() + strings


def test_character_map_takes_the_longest_key_and_keeps_alignment():
    model = piece.PieceModel(tokenizer_path(PIECES))
    model.map = piece.CharacterMap(double_array({b"a": b"A", b"ab": b"X", b"abc": b"yy", "é".encode(): b"e", b"\t": b" "}))
    normal, at = model.normalise("abcab\téa")
    assert normal == "▁yyX▁eA".encode()
    ids, spans = model.encode("abcab\téa")
    pieces = [model.pieces[i].decode() for i in ids]
    assert "".join(pieces) == "▁yyX▁eA"
    source = "abcab\téa".encode()
    assert spans[0, 0] == 0 and spans[-1, 1] == len(source) and (np.diff(spans[:, 0]) >= 0).all()
    assert at.tolist()[3:5] == [0, 0] and at.tolist()[5] == 3


def test_round_trip_table(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    got = {(r.doc_id, r.ids_sha256): r for r in piece.round_trip(docs, tokenizer_path(PIECES)).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "")
        one = got[r.doc_id, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert one.n_tokens == len(ids) and one.covered_bytes == len((r.text or "").encode())
        assert one.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    encoded = piece.encode_table(docs.where("doc_id < 60"), tokenizer_path(PIECES))
    back = {r.doc_id: r.text for r in piece.decode_table(encoded, tokenizer_path(PIECES)).collect()}
    assert all(back[r.doc_id] == library.decode(library.encode(r.text or "")) for r in docs.where("doc_id < 60").collect())


def test_chunks_equal_the_library():
    coder, library = ChunkEncoder(tokenizer_path(BYTES), most_bytes=9000), Tokenizer.from_file(tokenizer_path(BYTES))
    texts = [*some_texts(400), None, "", "a <|endoftext|> b", "it's. we'll, 3.14 ..", "naïve. Ünü,\nZß"]
    for text, got in zip(texts, coder.encode_bytes(pa.array(texts)), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == (library.encode(text, add_special_tokens=False).ids if text else [])


class Counted:
    """Passes on what is asked of a tokenizer, or of its model, and counts the calls."""

    def __init__(self, real, calls):
        self.real, self.calls = real, calls

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.real, name)


def test_new_words_go_to_the_library_many_at_a_time():
    coder, library = ChunkEncoder(tokenizer_path(BYTES)), Tokenizer.from_file(tokenizer_path(BYTES))
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(3, 9))) + rnd.choice(["", "", "", "7", "!?", ".", ",", "'s"]) for _ in range(6000)]
    texts = [" ".join(words[k : k + 60]).replace(" ", "\n", k % 7) for k in range(0, 6000, 60)]
    calls: list[str] = []
    for name, value in list(vars(coder).items()):
        if type(value).__module__.startswith("tokenizers"):
            setattr(coder, name, Counted(value, calls))
    for _ in range(2):  # from the library, then from the store
        got = coder.encode_bytes(pa.array(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(calls) < 200  # a call a word: some 6000


def test_any_shape_of_column():
    coder, library = ChunkEncoder(tokenizer_path(BYTES), most_bytes=2000), Tokenizer.from_file(tokenizer_path(BYTES))
    texts = [None, "", "a b.", "\x01", "..", "x\ny", "\n", " a", "b <|endoftext|>", "c,d .e", "a\n.b 's", "ab\u0300c 日本 😀.", "x" * 3000, "1,2.3\n4"]
    whole = pa.array(texts * 3, pa.large_string())
    for column in (whole, whole.slice(3, 20), pa.array(texts, pa.string()).slice(2, 5), pa.array([], pa.string()), pa.array([None, ""], pa.string()), pa.array(["\t", " "])):
        expected = [library.encode(t, add_special_tokens=False).ids if t else [] for t in column.to_pylist()]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_bytes(column)] == expected


def test_words_round_trip_and_escape():
    rnd = random.Random(4)
    for _ in range(200):
        ids = np.array([rnd.randrange(1 << rnd.randrange(1, 33)) for _ in range(rnd.randint(0, 300))], np.uint64)
        words, at, escaped = token_file.pack(ids)
        assert (token_file.unpack(words, len(ids), at, escaped) == ids).all()
        assert set(at.tolist()) == {i for i, x in enumerate(ids.tolist()) if x >= token_file.ESCAPE}
    words, _, _ = token_file.pack(np.zeros(120, np.uint64))
    assert len(words) == 2  # sixty ids of one bit a word


def test_token_file(spark, docs):
    library = Tokenizer.from_file(tokenizer_path(BYTES))
    got = token_file.written_and_read(docs, tokenizer_path(BYTES), 2, parts=3).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    start, by_start = 0, {r.start: r for r in got}
    for r in rows:
        ids = [*(library.encode(r.text, add_special_tokens=False).ids if r.text else []), 2]
        one = by_start[start]
        assert (one.doc_id, one.n_tokens) == (r.doc_id, len(ids)) and one.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_file.written_and_read(docs.limit(0), tokenizer_path(BYTES)).count() == 0


def test_blocks_read_ids_back(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_file.write_ids(docs, path, tokenizer_path(BYTES), 2, 2, block_ids=100)
    blocks = spark.read.schema(token_file.BLOCKS).parquet(f"{path}/blocks")
    parts = {r.part: r for r in spark.read.schema(token_file.PARTS).parquet(f"{path}/parts").collect()}
    at = 0
    for b in blocks.select("part", "seq", "start", "n_ids").orderBy("part", "seq").collect():
        assert parts[b.part].part_start + b.start == at
        at += b.n_ids
    library = Tokenizer.from_file(tokenizer_path(BYTES))
    by_id = {r.doc_id: r.ids for r in token_file.read_ids(blocks).where("doc_id is not null").collect()}
    for r in docs.where("doc_id is not null").collect():
        assert by_id[r.doc_id] == [*(library.encode(r.text, add_special_tokens=False).ids if r.text else []), 2]


def check_packing(rows, limit):
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return by_doc, len(by_sequence)


def test_packing(spark, docs):
    library = Tokenizer.from_file(tokenizer_path(BYTES))
    rows = packing.packed_documents(docs, tokenizer_path(BYTES)).collect()
    by_doc, n = check_packing(rows, 2048)
    total = 0
    for r in docs.where("doc_id is not null").dropDuplicates().collect():
        ids = np.array([*(library.encode(r.text, add_special_tokens=False).ids if r.text else []), 0], "<u4")
        pieces = sorted({(p.piece, p.start, p.length, p.ids_crc32) for p in by_doc[r.doc_id]})
        cut = len(ids) % 2048 or 2048
        edges = [0, *range(cut, len(ids) + 1, 2048)]
        assert pieces == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    total = sum(r.length for r in rows)
    assert n <= -(-total // 2048) + 1
    assert packing.packed_documents(docs.limit(0), tokenizer_path(BYTES)).count() == 0


def test_packing_in_blocks(spark):
    rnd = random.Random(1)
    rows = [(i, 0, 0, rnd.choice([rnd.randint(1, 400), rnd.randint(1, 2048), 1100, 2048]), 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing.PIECES).coalesce(2)
    out = packing.pack(pieces, 2048, block_rows=250).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    _, n = check_packing(out, 2048)
    whole = packing.local_search(packing.best_fit([r[3] for r in rows], 2048), [r[3] for r in rows], 2048)
    assert n <= len(whole) * 1.02


def test_local_search_empties_sequences():
    # Best fit by decreasing length leaves 3 sequences; an exchange of two for one makes it 2.
    lengths_ = [6, 5, 4, 3, 2]
    bins = [[0, 2], [1, 3], [4]]
    done = packing.local_search([list(b) for b in bins], lengths_, 10)
    assert len(done) == 2 and sorted(i for b in done for i in b) == [0, 1, 2, 3, 4]
    rnd = random.Random(3)
    for _ in range(30):
        sizes = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 60))]
        start = packing.best_fit(sizes, 100)
        done = packing.local_search([list(b) for b in start], sizes, 100)
        assert sorted(i for b in done for i in b) == list(range(len(sizes))) and len(done) <= len(start)
        assert all(sum(sizes[i] for i in b) <= 100 for b in done)
        assert sum(sum(sizes[i] for i in b) ** 2 for b in done) >= sum(sum(sizes[i] for i in b) ** 2 for b in start)


def test_token_counts(spark, docs):
    library = Tokenizer.from_file(tokenizer_path(BYTES))
    sizes = [len(library.encode(r.text, add_special_tokens=False).ids) if r.text else 0 for r in docs.collect()]
    counts = lengths.token_counts(docs, tokenizer_path(BYTES))
    table = lengths.length_table(lengths.histogram(counts))
    for r in table.collect():
        assert r.n_docs == sizes.count(r.n_tokens)
        assert r.docs_to == sum(s <= r.n_tokens for s in sizes) and r.tokens_to == sum(s for s in sizes if s <= r.n_tokens)
        assert r.docs_beyond == sum(s > r.n_tokens for s in sizes) and r.tokens_beyond == sum(s for s in sizes if s > r.n_tokens)
        assert r.truncated_total == sum(min(s, r.n_tokens) for s in sizes)
    limits = [1, 2, 7, 100, 2048, 10**6]
    got = {r.context_limit: r for r in lengths.truncated_totals(table, limits).collect()}
    assert all(got[n].truncated_total == sum(min(s, n) for s in sizes) and got[n].total_tokens == sum(sizes) for n in limits)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r.share: r.n_tokens for r in lengths.quantiles(table, shares).collect()}
    ordered = sorted(sizes)
    assert all(found[q] == ordered[max(1, int(np.ceil(q * len(sizes)))) - 1] for q in shares)
    assert lengths.length_table(lengths.histogram(counts.where(F.lit(False)))).count() == 0


def _raising_step(done: list[list[int]], sizes: list[int], limit: int) -> bool:
    """Whether any move or exchange, one-for-one or two-for-one, between underfull sequences raises the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in done]
    under = [k for k in range(len(done)) if fill[k] < limit]
    for a in under:
        for b in under:
            ones, others = ([sizes[i] for i in done[k]] for k in (a, b))
            give = [(x,) for x in ones] + list(itertools.combinations(ones, 2))
            take = [()] + [(x,) for x in others] + list(itertools.combinations(others, 2))
            for come, go in itertools.product(give, take) if a != b else ():
                gain = sum(come) - sum(go)
                if len(come) + len(go) < 4 and not (len(come) == 2 and not go) and 0 < gain <= limit - fill[b] and fill[b] + gain > fill[a]:
                    return True
    return False


@pytest.mark.parametrize(("n", "low", "high", "most"), [(1000, 300, 1000, 324), (300, 300, 1000, 98), (600, 400, 1100, 225)])
def test_local_search_beats_best_fit(n, low, high, most):
    rnd = random.Random(1)
    sizes = [rnd.randint(low, high) for _ in range(n)]
    start = packing.best_fit(sizes, 2048)
    done = packing.local_search([list(b) for b in start], sizes, 2048)
    assert sorted(i for b in done for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= 2048 for b in done)
    assert len(done) <= most < len(start)


def test_no_step_is_left_at_the_end():
    rnd = random.Random(4)
    for _ in range(40):
        sizes = [rnd.randint(20, 70) for _ in range(rnd.randint(2, 40))]
        done = packing.local_search(packing.best_fit(sizes, 100), sizes, 100)
        assert len(done) == -(-sum(sizes) // 100) or not _raising_step(done, sizes, 100)


@pytest.mark.parametrize("operator, query", [(packing, packing.token_pieces), (lengths, lengths.token_counts)])
def test_texts_are_encoded_in_slices_of_few_bytes(spark, monkeypatch, operator, query):
    """Not in slices as large as Spark's batches: a worker holds many times a slice's bytes."""
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": ["word " * 800] * 2000})
    seen = []
    monkeypatch.setattr(operator, "map_batches", lambda _, run, schema, *bounds: seen.extend(part.nbytes for part in slices(batch, *bounds)))
    query(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer_path(BYTES))
    assert seen and max(seen) <= 2 << 20


def test_chunks_met_again_outlive_a_full_store():
    """Those met in any slice since the store was last full, not in the last slice alone; ids stay the library's."""
    tok, library = ChunkEncoder(tokenizer_path(BYTES), 20_000), Tokenizer.from_file(tokenizer_path(BYTES))
    rnd = random.Random(3)
    often = ["alpha beta, gamma.", "delta 17 x"]
    texts = [often, often, *([" ".join("".join(rnd.choices("abcdefgh", k=7)) for _ in range(60))] for _ in range(20))]
    before = 0
    for some in texts:
        found = tok.encode_bytes(pa.array(some))
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(x, add_special_tokens=False).ids for x in some]
        stored = tok.store.known["chunks"][0].to_pylist()
        if len(stored) < before:
            break
        before = len(stored)
    assert len(stored) < before and any("alpha" in x for x in stored) and any("delta" in x for x in stored)
