"""Odd rows that every text operator must survive, and plain helpers for brute force."""

import random
import re

CLASH = "_n _text _plain _len _head _full _size _keep h g fp id root ids decoded words block part pos shingle sid wid n start end spans items key line kept data slot shard".split()
SPACES = " \t\n\x0b\x0c\r"
BENCHMARK = [
    (1, "the quick brown fox jumps over the lazy dog again and again until night falls"),
    (2, "four words only here"),
    (3, "seven words are one window of this"),
    (10, "the quick brown fox jumps over the lazy dog again and again until night falls"),
    (4, None),
    (5, "... --- !!!"),
    (6, "word"),
]
LONG = " ".join(f"longword{k % 977}" for k in range(30_000))


def odd_rows():
    rng = random.Random(5)
    base = "It was the best of times, it was the worst of times, it was the age of wisdom and of foolishness.\nA second line that many have.\n"
    rows = [
        (0, base), (1, base), (2, base + "tail"), (3, None), (4, ""), (5, "   \t\n\x0b "), (6, "x"), (7, LONG), (8, LONG + " end"),
        (9, "a" * 3000), (10, "a" * 3000 + "b"), (11, "ab" * 900), (12, "\x00" * 80 + "\x1c\x1d\x1e\x1f \x85"), (13, "é" * 70 + "ñ中文 😀" * 9),
        (14, "THE QUICK, brown fox jumps; over the lazy-dog again and again until night falls! Yes."), (15, "so FOUR words only here then"),
        (16, "seven words are one window of this"), (17, "<|endoftext|> and <|startoftext|>'s it'll  two  spaces \r\n end "), (18, base.upper()),
        (18, base.upper()), (19, "word word word"), (20, "not the quick brown fox jumps over the lazy cat"), (21, "A second line that many have.\nA second line that many have."),
        (-3, "a negative id with A second line\na second LINE that many have.  \r"), (None, "no id but text\nA second line that many have."), (None, None),
    ]
    words = [f"w{k}" for k in range(40)]
    for k in range(30, 60):
        rows.append((k, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6)))))
    rows += [(70 + k, rows[30][1] + f" {k}") for k in range(6)]
    return rows


def odd_docs(spark, rows=None):
    """Documents with further columns whose names clash with those used inside."""
    rows = odd_rows() if rows is None else rows
    extra = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", None, *["clash"] * len(CLASH)) for i, t in rows], f"doc_id long, text string, lang string, source string, {extra}")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def rank(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def same_rows(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))
