"""Operators 1 and 2: ids against the tokenizers library, packing, file round trips."""

import glob
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from carelake.llm import packing, tokenfile, tokens
from carelake.llm.common import kept_in_worker
from carelake.llm.tokens import encode, tokenizer_path

from .cases import odd_rows, table

BYTE, WORD = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", "<|endoftext|> a<|startoftext|>", "  two  spaces \n\n x\t", "漢字 is", "naïve café’s", "don't I'LL we've 12a3",
       "\x1c\x85 z", "a" * 5000, " " * 300 + "b", "\xa0nb\xa0sp", "\n \n", " lead", "trail ", "x́ é", "ΑΣ ς", "…​!",
       "hello <|endoftext|> x", "a  <|endoftext|>  <|startoftext|>b", "<|endoftext|>" * 3, "A<|ENDOFTEXT|> <|endoftext |>"]


def _ids(path, text):
    t = Tokenizer.from_file(path)
    return np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path,cut", [(BYTE, "keeps_space"), (WORD, "drops_space")])
def test_ids_are_the_librarys(spark, path, cut):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    t = Tokenizer.from_file(path)
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert encode(pa.array(texts), path, cut) == want


@pytest.mark.parametrize("path,cut", [(BYTE, "keeps_space"), (WORD, "drops_space")])
def test_ids_of_odd_characters_are_the_librarys(path, cut):
    rng, t = random.Random(4), Tokenizer.from_file(path)
    signs = list("aAsStTJHWIéÜßſK 0 1  \n\n\t\r\v\f''.,-<|>()`=漢かж。、  Σς") + [
        "\u0308", "\u0331", "\u030c", "\u0307", "\u0338", "\x85", "\xa0", "\u2003", "\u2028", "\u200b", "\ufeff",
        "\x1c", "\x00", "\x7f", "\u2013", "\u201d", "\xb2", "क्षि", "가각", "\U0001f600", "'re", "'LL", "don't",
        "<|endoftext|>"]
    for _ in range(20):
        texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 2, 3, 5, 9, 40]))) for _ in range(500)]
        want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
        assert encode(pa.array(texts), path, cut) == want


@pytest.mark.parametrize("path,cut", [(BYTE, "keeps_space"), (WORD, "drops_space")])
def test_the_library_meets_a_word_once(monkeypatch, path, cut):
    learned, learn, t = Counter(), tokens.Encoder._learn, Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "CACHE_PARTS", 60)
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, parts: (learned.update(parts), learn(self, parts))[1])
    kept_in_worker.clear()
    for i in range(100):  # rare words fill the cache again and again
        texts = [f"x often{sign} (often) usual{sign} often\nusual {'rare' * (i + 1)}{i}" for sign in ".,;:!?"]
        want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
        assert encode(pa.array(texts), path, cut) == want
    assert set(learned.values()) == {1}
    assert len([p for p in learned if "often" in p or "usual" in p]) <= 4
    kept_in_worker.clear()


def _fill(ranges, capacity):
    bins, seen = defaultdict(list), Counter()
    for length, low, high, first, per, place in ranges:
        for r in range(low, high):
            bins[first + (r - low) // per].append((place + (r - low) % per * length, length))
            seen[length, r] += 1
    assert set(seen.values()) <= {1}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return Counter(length for own in bins.values() for _, length in own), len(bins)


def test_plan_places_every_piece_once_and_tightly():
    rng = np.random.default_rng(1)
    cases = [{}, {2048: 3}, {1: 5000}, {1025: 7, 1023: 7}, {700: 10, 300: 3, 2000: 1}]
    cases += [dict(Counter(rng.integers(1, 2049, rng.integers(1, 400)).tolist())) for _ in range(15)]
    for counts in cases:
        placed, bins = _fill(packing.plan(counts), 2048)
        assert placed == Counter(counts)
        least = -(-sum(x * n for x, n in counts.items()) // 2048)
        assert bins <= 1.1 * least + 2
    lengths = np.clip(rng.lognormal(6.5, 0.9, 30000).astype(int), 1, 2048)
    counts = dict(Counter(lengths.tolist()))
    assert _fill(packing.plan(counts), 2048)[1] <= 1.01 * lengths.sum() / 2048 + 1


def test_packing(spark):
    rows = odd_rows()
    pieces = packing.token_pieces(table(spark, rows), BYTE)
    placed = packing.place(pieces).cache()
    got = placed.collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.append(_ids(BYTE, t), 0).astype("<u4")
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want.update((i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.key, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == want
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    for s in packing.sequences(placed).collect():
        own = sorted((r.offset, r.length, bytes(r.ids)) for r in got if r.sequence_id == s.sequence_id)
        assert s.ids == b"".join(x for _, _, x in own) and len(s.ids) <= 4 * 2048
        assert [o for o, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]
    report = packing.packing_report(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in report) == want
    assert packing.packing_report(table(spark, rows).limit(0)).count() == 0


def test_token_files_round_trip(spark, tmp_dir, monkeypatch):
    rows, folder = odd_rows(), f"{tmp_dir}/tokens"
    tokenfile.write_token_files(table(spark, rows), folder, WORD, "drops_space", 2)
    got = tokenfile.stored_documents(spark, folder).collect()
    order = sorted(got, key=lambda r: r.start)
    assert [r.key for r in order] == sorted([i for i, *_ in rows if i is not None]) + [None] * sum(
        i is None for i, *_ in rows)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.append(_ids(WORD, t), 2).astype("<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.key, r.n_tokens, r.ids_crc32) for r in got) == want
    some = tokenfile.read_token_files(spark, folder, {3, 64, 999}).collect()
    assert Counter(r.key for r in some) == Counter([3, 64])
    assert all(np.array_equal(np.frombuffer(r.ids, "<u4")[:-1], _ids(WORD, dict((i, t) for i, t, *_ in rows)[r.key]))
               for r in some)
    empty = f"{tmp_dir}/none"
    tokenfile.write_token_files(table(spark, rows).limit(0), empty, WORD, "drops_space", 2)


def test_shards_are_seekable_zstandard_and_checked(monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_BYTES", 64)
    shard, docs = tokenfile.Shard(), [(5, b"\x01\0\0\0" * 100), (7, b""), (None, b"\x02\0\0\0")]
    for key, ids in docs:
        shard.add(key, ids)
    content = shard.content() + tokenfile.SEEKABLE_MAGIC
    stream = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    assert stream.read() == b"".join(ids for _, ids in docs)
    assert [(k, ids) for _, k, _, ids in tokenfile.read_shard(content)] == docs
    assert [k for _, k, _, _ in tokenfile.read_shard(content, {7})] == [7]
    broken = bytearray(content)
    broken[12] ^= 1
    assert [k for _, k, _, _ in tokenfile.read_shard(bytes(broken), {7})] == [7]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokenfile.read_shard(bytes(broken), {5}))
    with pytest.raises(ValueError):
        list(tokenfile.read_shard(content[:-1]))


def test_files_close_with_the_magic_number(spark, tmp_dir):
    folder = f"{tmp_dir}/tokens"
    tokenfile.write_token_files(table(spark, odd_rows()[:9]), folder, WORD, "drops_space", 2)
    files = glob.glob(f"{folder}/part-*")
    assert files and all(open(f, "rb").read().endswith(tokenfile.SEEKABLE_MAGIC) for f in files)
