"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens; a token sequence it accepts is the one the merges make of its bytes. It is compiled by one gadget
per merge, in order. It starts with one state and an arc for every byte. The gadget of the merge ``u v -> w``

* cuts arc ``v`` from the state that ``u`` leads to (``u v`` must have been merged),
* adds arc ``w`` to every state that has arc ``u``, leading to the state that ``v`` led to before the cut.

Each arc leads to one state of its own, so a state is named by the token before it and the automaton is deterministic. A gadget
is stored as what it changes (which arc, at which step, copied from where); an entry of the transition table is
worked out from those records when it is first needed and then kept. Encoding a pre-split word walks the table along
the longest arcs that fit the bytes, and steps back where no arc goes on: a prefix has one accepted path at most, so a
position given up is never tried again. Decoding emits the arc labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from fairtag.llm.tables import small_batches

# Fixed value: how the vocabulary's pre-tokenizer splits text. White space is spelled out (White_Space of Unicode).
_WS = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: Words and transitions a Python worker keeps at most; beyond it they are worked out anew.
KEPT_WORDS = 200_000
KEPT_ARCS = 1_000_000
_NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in letters.values()))
    return letters


class Automaton:
    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        """``labels``: bytes of each token; ``merges``: (left, right, token) in order; ``special``: literal strings."""
        self.labels, self.special = labels, special
        self.born: dict[int, int] = {}
        self.head: dict[int, int] = {}
        self.tail: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        merged = {w for _, _, w in merges}
        self.byte_arcs = {t for t, b in labels.items() if len(b) == 1 and t not in merged}
        for t in self.byte_arcs:
            self.born[t] = 0
        for step, (u, v, w) in enumerate(merges, 1):
            self._gadget(step, u, v, w)
        self.arcs: dict[int, bool] = {}
        self.tokens = {labels[t]: t for t in self.born}
        # The greatest length of a label by its first four bytes, so a walk tries no more.
        self.reach: dict[bytes, int] = {}
        for label in self.tokens:
            if len(label) > 3:
                self.reach[label[:4]] = max(self.reach.get(label[:4], 4), len(label))
        self.splits = regex.compile(SPLIT)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words: dict[str, bytes] = {}
        self.emit = {**labels, **{t: s.encode() for s, t in special.items()}}

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        if u in self.born and v in self.born and self._present(u, v, step - 1):
            self.cut[u, v] = step
            self.born[w], self.head[w], self.tail[w] = step, u, v

    def _present(self, state: int, arc: int, step: int) -> bool:
        """Whether ``state`` has ``arc`` after ``step`` gadgets."""
        while True:
            if self.cut.get((state, arc), _NEVER) <= step:
                return False
            made, arc_made = self.born[state], self.born[arc]
            if arc_made > step:
                return False
            if made > arc_made or made and arc_made == 0:
                state, step = self.tail[state], made - 1
            elif arc_made:
                arc, step = self.head[arc], arc_made
            else:
                return True

    def follows(self, state: int, arc: int) -> bool:
        """The entry of the transition table, worked out when it is first needed."""
        if len(self.arcs) >= KEPT_ARCS:
            self.arcs.clear()
        known = self.arcs[state << 32 | arc] = self._present(state, arc, _NEVER - 1)
        return known

    def walk(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word."""
        n, tokens, reach, arcs = len(word), self.tokens, self.reach, self.arcs
        whole = tokens.get(word)
        if whole is not None:  # the start state has an arc for every token
            return [whole]
        path, ends, at, given_up, state = [], [], 0, set(), -1
        longest = min(n, reach.get(word[:4], 3))
        while at < n:
            for end in range(at + longest, at, -1):
                token = tokens.get(word[at:end])
                if token is None or end in given_up:
                    continue
                if state >= 0:
                    fits = arcs.get(state << 32 | token)
                    if not (self.follows(state, token) if fits is None else fits):
                        continue
                path.append(token)
                ends.append(end)
                at, state = end, token
                longest = min(n - at, reach.get(word[at:at + 4], 3))
                break
            else:
                given_up.add(at)
                if not path:
                    raise ValueError("the vocabulary lacks a byte of the text")
                last = ends.pop()
                path.pop()
                at = ends[-1] if ends else 0
                state = path[-1] if path else -1
                longest = last - at - 1
        return path

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.specials is None:
            return self._plain(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += [self._plain(text[at:found.start()]), self.special[found[0]].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, self._plain(text[at:] if at else text)])

    def _plain(self, text: str) -> bytes:
        words, out = self.words, []
        for word in self.splits.findall(text):
            ids = words.get(word)
            if ids is None:
                if len(words) >= KEPT_WORDS:
                    words.clear()
                ids = np.array(self.walk(word.encode()), "<u4").tobytes()
                if len(word) <= 64:
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.emit.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _compiled(text: str) -> Automaton:
    spec = json.loads(text)
    letters, vocab = _byte_letters(), spec["model"]["vocab"]
    labels = {t: bytes(letters[c] for c in s) for s, t in vocab.items()}
    merges = []
    for pair in spec["model"]["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for content, token in special.items():
        labels.pop(token, None)
    return Automaton(labels, merges, special)


def load(path: str) -> Automaton:
    with open(path, encoding="utf-8") as file:
        return _compiled(file.read())


def _mapped(documents: DataFrame, path: str, columns: list[str], make: Callable, schema: str | StructType) -> DataFrame:
    """Send the vocabulary file once to each executor and map the batches with ``make(automaton, batch)``."""
    small_batches(documents.sparkSession)
    with open(path, encoding="utf-8") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary, 1.5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _compiled(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                yield make(automaton, batch.slice(lo, ROWS))

    return documents.select(*columns).mapInArrow(run, schema)


#: Documents of one output batch.
ROWS = 256


def encode_texts(documents: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (array<int>) of every whole text; a null text counts as empty."""
    def make(automaton: Automaton, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(automaton.encode(t or ""), "<i4") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"]
        )

    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>"])
    return _mapped(documents, path, [*dict.fromkeys([*keep, "text"])], make, schema)


def decode_ids(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``text`` that ``ids`` stand for; null ids give a null text."""
    def make(automaton: Automaton, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if ids is None else automaton.decode(np.array(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    kinds = dict(encoded.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"])
    return _mapped(encoded, path, [*dict.fromkeys([*keep, "ids"])], make, schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded and decoded back in one pass.

    A null or empty text has no tokens. Repeated rows give repeated results; other columns are not looked at.
    """
    def make(automaton: Automaton, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids_sha, text_sha = [], [], []
        for text in batch.column("text").to_pylist():
            ids = automaton.encode(text or "")
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(automaton.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    return _mapped(rows, path, ["doc_id", "text"], make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(documents: DataFrame, path: str) -> DataFrame:
    """``documents`` with all their columns, then ``ids`` (array<int>), ``n_tokens`` and ``round_trip``: whether the ids decode to the text.

    A null text counts as empty. Where an input column has one of these names, underscores are put behind the new one.
    """
    taken, names = {c.lower() for c in documents.columns}, []
    for name in ("ids", "n_tokens", "round_trip"):
        while name in taken:
            name += "_"
        names.append(name)

    def make(automaton: Automaton, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = [np.frombuffer(automaton.encode(t), "<i4") for t in texts]
        same = [automaton.decode(i) == t for i, t in zip(ids, texts)]
        made = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    kinds = (ArrayType(IntegerType()), LongType(), BooleanType())
    schema = StructType([*documents.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds))])
    return _mapped(documents, path, [f"`{c}`" for c in documents.columns], make, schema)
