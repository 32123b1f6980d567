"""Byte-pair encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so it marks
a certain cut: the fragments between such cuts are encoded on their own and concatenated.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortline.llm.common import kept_by_worker, text_or_empty, travels

# Pieces that a task remembers; beyond that all are forgotten together.
REMEMBERED = 400_000
# Longer pieces are not remembered.
LONG = 48
# Texts that a task turns into Python objects at a time (a longer text is alone).
CHUNK_ROWS, CHUNK_BYTES = 256, 4 << 20


# Places where a pre-token certainly starts: a word or a mark that ends at white space, white
# space as the file's own pattern takes it, else the rest up to white space. The library
# splits what lies between them. Texts with the separators \x1c-\x1f, which Python alone
# takes for white space, are left to it as a whole.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PIECES = re.compile(rf" ?[{LETTERS}]+(?=[\s.,;:!?]|\Z)|[.,;:!?]+(?=\s|\Z)| ?\S+|\s+(?!\S)|\s+")
ONE_WORD = re.compile(rf" ?[{LETTERS}]+")
UNSURE = re.compile("[\x1c-\x1f]")


class Memory(dict):
    """Ids of pieces, made when first asked for; bounded in number and in the length of pieces."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for the content of a byte-level tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        vocab = model["vocab"]
        # two letters that stand side by side in some token: all other places are cuts
        self.inside = {t[k : k + 2] for t in vocab for k in range(len(t) - 1)}
        library = Tokenizer.from_str(content)
        self.split, self.merge = library.pre_tokenizer.pre_tokenize_str, library.model.tokenize
        special = [t for t in spec["added_tokens"] if t["special"]]
        if len(special) != 1 or special[0]["lstrip"] or special[0]["rstrip"] or special[0]["single_word"] or spec["normalizer"]:
            raise ValueError("expected one plain special token and no normalizer")
        self.special, self.special_id = special[0]["content"], np.uint32(special[0]["id"]).tobytes()
        letter = byte_letters()
        self.letters = {b: c for c, b in letter.items()}
        names = vocab | {self.special: special[0]["id"]}
        self.spelled = [b""] * (max(names.values()) + 1)
        for token, k in names.items():
            self.spelled[k] = bytes(letter[c] for c in token)
        self.pieces = Memory(self.encode_piece)

    def cut(self, word: str) -> list[str]:
        """Fragments of a pre-token between its forced boundaries."""
        inside, out, start = self.inside, [], 0
        if inside.issuperset(map(add, word, word[1:])):
            return [word]
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in inside:
                out.append(word[start:k])
                start = k
        out.append(word[start:])
        return out

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a text, as 32-bit numbers, without looking for the special token."""
        if ONE_WORD.fullmatch(piece):
            words = ["".join([self.letters[b] for b in piece.encode()])]
        else:
            words = [w for w, _ in self.split(piece)]
        return b"".join([array("I", [t.id for t in self.merge(f)]).tobytes() for w in words for f in self.cut(w)])

    def encode_segment(self, text: str) -> bytes:
        """Ids of a text without the special token, piece by remembered piece."""
        if UNSURE.search(text):
            return self.encode_piece(text)
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.special_id.join([self.encode_segment(s) if s else b"" for s in text.split(self.special)])

    def decode(self, ids: bytes) -> str:
        spelled = self.spelled
        return b"".join([spelled[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def codec_of(content: str) -> Codec:
    """The worker's codec for a tokenizer file, with what it remembers."""
    return kept_by_worker(("codec", content), lambda: Codec(content))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few rows and few bytes, so that memory stays bounded."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = size = 0
    for k, n in enumerate(sizes):
        if k > start and (size + n > CHUNK_BYTES or k - start >= CHUNK_ROWS):
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if sizes:
        yield batch.slice(start)


def _mapped(df: DataFrame, path: str, source: str, target: str, kind: str, convert) -> DataFrame:
    """Add ``target``, made from ``source`` by ``convert(codec, value)``."""
    with open(path, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not grow
    kept = [c for c in df.columns if c != target]
    schema = df.select(*kept).schema.add(target, kind)
    arrow = pa.string() if kind == "string" else pa.binary()

    def run(batches):
        codec = codec_of(content.value)
        for batch in batches:
            for part in slices(batch, source):
                values = pa.array([convert(codec, v.as_py()) for v in part.column(source)], arrow)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], values], names=[*kept, target])

    return df.select(*df.columns).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of a text column (binary: little-endian unsigned 32-bit numbers).

    Ids equal those of the tokenizers library for the same byte-level file, without added
    special tokens; the special token's own string in a text becomes its id. NULL and
    empty texts have no ids. All columns stay and rows are independent: repeated rows
    repeat, hot groups do not matter, an empty table stays empty. A column already named
    like ``ids`` is replaced. Texts are handled whole, a few at a time.
    """
    return _mapped(docs, path, text, ids, "binary", lambda codec, v: codec.encode(v or ""))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that ids stand for, special tokens included; NULL and no ids give an empty text."""
    return _mapped(encoded, path, ids, text, "string", lambda codec, v: codec.decode(v or b""))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of ids and of the decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    ids = encode(texts, path).select("doc_id", "ids")
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    done = decode(ids, path)
    return done.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


travels(__name__)
