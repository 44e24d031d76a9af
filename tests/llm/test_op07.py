import random
import zlib

import numpy as np
from helpers import documents, fixture_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm.op07_packing import Encoder, pack, pack_histogram, tokenizer_path


def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path(None))


TOK = tokenizer()
ENC = Encoder(tokenizer_path(None))


def plain(text):
    return np.array(TOK.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", " ", "  ", "\n", "\n\n", "'s", "don't", "é", "ß", " ", "　", "1", "23", ".",
                                 ",", "!!", "\t", "\r", "漢", "\x1c", "\x00", "᠎", "<|endoftext|>", "x́", "‍"])
                | st.text(max_size=4), max_size=12).map("".join))
def test_ids_equal_those_of_tokenizers(text):
    assert ENC(text) == plain(text)


def test_ids_of_whole_documents_and_long_runs():
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    texts += ["a" * 50_000, " " * 5_000 + "x", "^" * 20_000, "", "漢" * 6_000, "<|endoftext|>a<|endoftext|>"]
    for t in texts:
        assert ENC(t) == plain(t)


def brute(rows, capacity):
    out = []
    for i, t, *_ in rows:
        ids = TOK.encode(t or "", add_special_tokens=False).ids + [0]
        cut = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        start = piece = 0
        while start < len(ids):
            part = ids[start:cut]
            out.append((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            start, cut, piece = cut, cut + capacity, piece + 1
    return sorted(out, key=str)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_pieces_and_places(spark):
    rows = fixture_rows()
    for capacity in (2048, 256):
        got = pack(documents(spark), capacity).collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute(rows, capacity)
        used = check_places(got, capacity)
        assert used <= -(-sum(r.length for r in got) // capacity) * 1.05 + 1
    assert pack(documents(spark, [])).collect() == []


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_histogram_packs_like_single_pieces():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 30, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        packer = pack_histogram(counts, capacity)
        assert packer.sequences <= best_fit_decreasing(sizes, capacity) + 1
        used, placed = {}, {}
        for size, rank, n, first, each, offset in packer.steps:
            for j in range(n):
                placed[(size, rank + j)] = True
                used.setdefault(first + j // each, []).append((offset + (j % each) * size, size))
        assert len(placed) == len(sizes) and set(used) == set(range(packer.sequences))
        for parts in used.values():
            end = 0
            for at, size in sorted(parts):
                assert at == end
                end += size
            assert end <= capacity


def test_large_pieces_are_matched_optimally():
    rng = random.Random(2)
    for _ in range(100):
        sizes = sorted((rng.randint(35, 100) for _ in range(rng.randint(1, 9))), reverse=True)

        def least(rest):  # fewest sequences by trying every partner of the largest
            if not rest:
                return 0
            options = [least(rest[1:])] + [least(rest[1:i] + rest[i + 1:]) for i in range(1, len(rest)) if rest[0] + rest[i] <= 100]
            return 1 + min(options)
        assert pack_histogram({s: sizes.count(s) for s in set(sizes)}, 100).sequences == least(sizes)
