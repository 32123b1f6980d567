"""Token alignment against a plain version over whole encodings."""

import hashlib
from bisect import bisect_right
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortline.llm import alignment
from cohortline.llm.bpe import byte_letters
from cohortline.llm.common import table
from tests.helpers import SF
from tests.llm.odd import odd_docs, odd_rows, same_rows

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "it's  two\n\nlines \t x", "▁", "a ▁b", "<|endoftext|> <s>x</s> <unk>", "<0x41>",
    "ﬁ ½ é é", "\x00 \x1c\x1d a\x1cb", "文本 文本文本", "🙂🙂 🙂", "word" * 300, "a b c d " * 200, "ß" * 90 + " " * 70 + "x", "   y", "a ", "a ",
]


@pytest.fixture(scope="module")
def tools():
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    return library, sentencepiece.SentencePieceProcessor(model_file=PIECE), byte_letters()


def plain(texts, tools):
    """The contract, token by token."""
    library, model, letters = tools
    names = {v: k for k, v in library.get_vocab().items()}
    docs = []
    for text in texts:
        found = {"a": [], "b": [], "groups": [], "links": []}
        if text:
            want = (" " + text).encode()
            a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            spell_a = [bytes(letters[c] for c in names[k]) for k in a]
            spell_b = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(spell_a) == want and b"".join(spell_b) == want:
                spans = []
                for ids, spelled in ((a, spell_a), (b, spell_b)):
                    at, out = 0, []
                    for k, s in zip(ids, spelled):
                        out.append((at, at + len(s), k))
                        at += len(s)
                    spans.append(out)
                ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                sides = [[[] for _ in ends] for _ in spans]
                for side, out in zip(spans, sides):
                    for at, _, k in side:
                        out[bisect_right(ends, at)].append(str(k))
                found["groups"] = ["|".join((",".join(left), ",".join(right))) for left, right in zip(*sides)]
                j = 0
                for s, e, k in spans[0]:
                    while spans[1][j][1] <= s:
                        j += 1
                    i = j
                    while i < len(spans[1]) and spans[1][i][0] < e:
                        found["links"].append((k, spans[1][i][2]))
                        i += 1
                found["a"], found["b"] = a, b
        docs.append(found)
    count = Counter(p for d in docs for p in set(d["links"]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    return [
        (
            len(d["a"]), len(d["b"]), len(d["groups"]), len(d["links"]), sum(count[p] == most[p[0]] for p in d["links"]), sum(count[p] for p in d["links"]),
            hashlib.sha256(";".join(d["groups"]).encode()).hexdigest() if d["a"] else "",
        )
        for d in docs
    ]


def unsorted(df):
    return [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]


@pytest.mark.parametrize("heavy", [alignment.HEAVY_PAIRS, 40, 0])
def test_odd_texts_with_pairs_sent_or_joined(spark, tools, heavy):
    rows = [*enumerate(ODD, 1000), *odd_rows()]
    want = [(i, *r) for (i, _), r in zip(rows, plain([t for _, t in rows], tools), strict=True)]
    same_rows(list(unsorted(alignment.agreement(odd_docs(spark, rows).repartition(3), BYTE, PIECE, heavy))), want)


def test_every_document_of_the_table(spark, tools):
    docs = table(spark, SF, "documents")
    given = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *w) for r, w in zip(given, plain([r.text for r in given], tools), strict=True))
    assert sorted(unsorted(alignment.agreement(docs, BYTE, PIECE))) == want


def test_repeated_and_missing_ids_are_documents_of_their_own(spark, tools):
    texts = ["one two", "one two", "three", "one"]
    docs = spark.createDataFrame(list(zip([7, 7, None, None], texts)), "doc_id long, text string")
    assert sorted(r[1:] for r in unsorted(alignment.agreement(docs, BYTE, PIECE))) == sorted(plain(texts, tools))


def test_empty_table(spark):
    assert alignment.agreement(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE).collect() == []


def test_forgotten_windows_change_nothing(tools):
    with open(BYTE, encoding="utf-8") as f, open(PIECE, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    listed = lambda: [list(column) for column in aligner.align(ODD).values()]
    first, met = listed(), len(aligner.text)
    assert listed() == first and len(aligner.text) == met
    aligner.forget()
    assert listed() == first
