"""Fill-in-middle against a plain cut of whole texts, with chunks so small that cuts and words meet their borders."""

import hashlib
import random
import re

import pytest

from fairtag.llm.fill_middle import Chunking, Document, Memo, digests, fill_in_middle

SCHEMA = "doc_id long, text string, form string, cut int, n string, output string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SMALL = Chunking(window=4, mean=8, least=5, most=24, block=64, cache=200)


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, n):
    rng = random.Random(seed)
    passage = " ".join("".join(rng.choice("abé🙂") for _ in range(rng.randint(1, 9))) for _ in range(60))
    pieces = ["a", "b", "é", "🙂", " ", "  ", "\t", "\n", "\x0b", "\x1f", " ", " ", "<", "<S", "<P", ">", "word", passage]
    for _ in range(n):
        yield "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 2, 5, 30, 200])))


@pytest.mark.parametrize("spec", [Chunking(), SMALL, Chunking(window=1, mean=1, least=1, most=1, cache=0)])
def test_against_plain_cuts(spark, spec):
    rows = [(i if i % 50 else None, t, None, 1, "x", None) for i, t in enumerate(texts(spec.mean, 250))]
    rows += [(1000 + i, t, None, None, None, "y") for i, t in enumerate([None, "", " ", "\n\t", "x", " x ", "<M>", "a<P>b", "a" * 70_000, " " * 9_000])]
    rows += [(2000 + i, " ".join(f"w{j % 97}" for j in range(20_000)), None, None, None, None) for i in range(6)]
    rows += rows[:3]
    frame = fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(4), spec)
    out = sorted(map(tuple, frame.collect()), key=str)
    want = sorted((plain(r[0], r[1]) for r in rows), key=str)
    assert out == want and {"plain", "psm", "spm"} == {w[2] for w in want}
    kept = sorted((r.doc_id, r.output_sha256, r.restored_sha256) for r in digests(frame).collect() if r.doc_id is not None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert kept == sorted((r[0], sha(plain(r[0], r[1])[5]), sha(r[1] or "")) for r in rows if r[0] is not None)


def test_empty_table(spark):
    assert digests(fill_in_middle(spark.createDataFrame([], SCHEMA))).collect() == []


def test_shared_chunks_are_summarised_once():
    class Counted(Memo):
        made = 0

        def summary(self, chunk):
            before = self.held
            out = super().summary(chunk)
            self.made += self.held != before
            return out

    memo = Counted(1 << 20)
    parts = [b"one two", b" three", b"fo", b"ur "] * 50
    document = Document(parts, memo)
    text = b"".join(parts).decode()
    assert memo.made == 4 and document.units == len(UNIT.findall(text))
    ends = [m.end() for m in UNIT.finditer(text)]
    assert [document.end(i) for i in range(document.units + 1)] == [0, *ends]
