"""BPE encoding and decoding, token records."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortline.llm import bpe, records
from cohortline.llm.common import stored
from cohortline.sources.storage import staging_path
from tests.llm.odd import odd_docs, odd_rows, rank, same_rows

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"ab  \n\t'sé中1２ \x00\x1c\x85\u0301😀!.İΣςAÉÑß", "<|endoftext|>", "<|startoftext|>", "'ll", "'S", "  ", "\r\n", "a" * 60, " the", "\u2009", "ΑΣ "]


def random_texts(n):
    rng = random.Random(2)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_codec_equals_library():
    codec = bpe.Codec(open(BYTES).read())
    library = Tokenizer.from_file(BYTES)
    for text in random_texts(4000) + [t or "" for _, t in odd_rows()]:
        ids = library.encode(text, add_special_tokens=False).ids
        found = codec.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == ids
        assert codec.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_decoding_any_ids():
    codec, library, rng = bpe.Codec(open(BYTES).read()), Tokenizer.from_file(BYTES), random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 6))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_forced():
    codec = bpe.Codec(open(BYTES).read())
    word = "xqzjkkvvbbqqxzzz"
    assert "".join(codec.cut(word)) == word and len(codec.cut(word)) > 1
    assert [t.id for f in codec.cut(word) for t in codec.merge(f)] == [t.id for t in codec.merge(word)]


def test_round_trip_of_odd_rows(spark):
    library, want = Tokenizer.from_file(BYTES), []
    for i, t in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same_rows([tuple(r) for r in bpe.round_trip(odd_docs(spark), BYTES).collect()], want)
    kept = bpe.encode(odd_docs(spark), BYTES)
    assert set(kept.columns) == set(odd_docs(spark).columns)  # a column named ids is replaced
    assert bpe.round_trip(odd_docs(spark, []), BYTES).count() == 0


def test_pieces_equal_library():
    encoder, library = records.Pieces(open(WORDS).read()), Tokenizer.from_file(WORDS)
    for text in random_texts(4000):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_records_of_odd_rows(spark):
    library, want, at = Tokenizer.from_file(WORDS), [], 0
    for i, t in sorted(odd_rows(), key=lambda r: (rank(r[0]), r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same_rows([tuple(r) for r in records.export(odd_docs(spark), WORDS).collect()], want)
    assert records.export(odd_docs(spark, []), WORDS).count() == 0


def test_shuffled_reads_and_damage(spark):
    path = staging_path(spark, "records-test")
    manifest = records.write_records(odd_docs(spark), path, WORDS, parts=2).collect()
    assert sum(r.n_docs for r in manifest) == len(odd_rows())
    part = max(manifest, key=lambda r: r.n_docs).part
    plain = list(records.read_records(path, part))
    order = np.random.default_rng(1).permutation(len(plain))
    for k, (before, doc_id, ids) in zip(order.tolist(), records.read_records(path, part, order), strict=True):
        assert (before, doc_id, ids.tolist()) == (plain[k][0], plain[k][1], plain[k][2].tolist())
    record = bytearray(records.frame(records.pack_ids(None, np.array([1, 70_000]), False)))
    assert [x if x is None else x.tolist() for x in records.unpack_ids(records.unframe(bytes(record)))] == [None, [1, 70_000]]
    for at in (3, 9, 20, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_stored_tables_survive_in_the_shared_folder(spark):
    df = stored(spark.range(5), "test")
    assert sorted(r.id for r in df.collect()) == list(range(5))
