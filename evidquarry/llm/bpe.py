"""BPE encoding and decoding by a prefix-sharing walk over a trie of distinct words.

For byte-pair merges, the encoding of a prefix followed back from its end is fixed by one
state: the last token of that prefix. A token t that ends at a place is the last token there
just when the last token p of the prefix before t stays next to it, that is when p + t
encodes to [p, t]. So the words that a batch of texts brings are put in order, which is the
depth-first order of their trie; a stack keeps the states of the current path, the states of
a prefix shared with the previous word are taken over, and only new nodes are computed, each
from the tokens that end there. Whether two tokens stay apart is worked out by merging the
pair, once, and remembered. A word of any length costs a number of steps in proportion to it.

Encodings of words are remembered in a table of bounded size in each task; ids are looked up
in the vocabulary again to decode. The vocabulary is a fixed file of some MB, read on the
driver from the path given and sent to the tasks.

Defined results: a null text is encoded as an empty one (no ids, empty text); special
strings in a text become their own ids and decode to themselves; repeated rows each give a
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidquarry.llm.base import table, text_portions
from evidquarry.llm.pretokens import BYTE_RULE, Splitter, Vocabulary

REMEMBERED_WORDS, REMEMBERED_PAIRS = 350_000, 250_000
CHUNK = 1_000_000  # characters whose words are held at a time
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class TrieEncoder:
    """Token ids of words, computed along the depth-first order of their trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.token = {word: number for (word, _), number in vocabulary.ids.items() if vocabulary.merged(word) == [number]}
        lengths: dict[int, set[int]] = {}
        for word in self.token:
            lengths.setdefault(word[-1], set()).add(len(word))
        self.lengths = [sorted(lengths.get(b, ()), reverse=True) for b in range(256)]
        self.apart: dict[int, bool] = {}  # key: left id * 2^20 + right id

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether *left* followed by *right* encodes to just these two; remembered."""
        if len(self.apart) > REMEMBERED_PAIRS:
            self.apart.clear()
        word = self.vocabulary.bytes_of[left] + self.vocabulary.bytes_of[right]
        known = self.apart[left << 20 | right] = self.vocabulary.merged(word) == [left, right]
        return known

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) for distinct words, in their trie's depth-first order."""
        last: list[int] = [-1]  # last token at each depth of the current path
        jump: list[int] = [0]  # depth at which that token begins
        path = b""
        token, apart, lengths = self.token.get, self.apart.get, self.lengths
        for word in sorted(words):
            depth = len(commonprefix((path, word)))
            del last[depth + 1 :], jump[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                for length in lengths[word[end - 1]]:
                    start = end - length
                    if start < 0:
                        continue
                    number = token(word[start:end])
                    if number is None:
                        continue
                    if start:
                        left = last[start]
                        known = apart(left << 20 | number)
                        if not (self._stay_apart(left, number) if known is None else known):
                            continue
                    last.append(number)
                    jump.append(start)
                    break
                else:
                    raise ValueError(f"no token ends at byte {end} of {word[:80]!r}")
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at = jump[at]
            path = word
            ids.reverse()
            yield word, ids


class Codec:
    """Texts to ids and back, with a bounded memory of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.encoder, self.split = TrieEncoder(vocabulary), Splitter(BYTE_RULE)
        self.packed: dict[str, bytes] = {}
        top = max(vocabulary.bytes_of) + 1
        self.bytes_of = [vocabulary.bytes_of.get(i, b"") for i in range(top)]

    def _learn(self, words: set[str]) -> None:
        spelled = {w.encode("utf-8", "surrogatepass"): w for w in words}
        for word, ids in self.encoder.encode(spelled):
            self.packed[spelled[word]] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; new words of all texts share one trie."""
        pieces = [[(p, None) if k % 2 else (p, self.split(p)) for k, p in enumerate(self.vocabulary.pieces(t))] for t in texts]
        needed = set().union(*(words for parts in pieces for _, words in parts if words))
        new = needed - self.packed.keys() if self.packed else needed
        if new:
            if len(self.packed) + len(new) > REMEMBERED_WORDS:
                self.packed.clear()
                new = needed
            self._learn(new)
        special = {s: np.array([n], "<u4").tobytes() for s, n in self.vocabulary.special.items()}
        return [b"".join(special[p] if words is None else b"".join(map(self.packed.__getitem__, words)) for p, words in parts) for parts in pieces]

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _codec(content: str) -> Codec:
    return Codec(Vocabulary(content))


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_COLUMNS = {
    "n_tokens": ("long", lambda packed, texts: pa.array([len(p) // 4 for p in packed], pa.int64())),
    "token_ids": ("array<int>", lambda packed, texts: pa.array([np.frombuffer(p, "<i4") for p in packed], pa.list_(pa.int32()))),
    "decoded": ("string", lambda packed, texts: pa.array(texts, pa.string())),
    "ids_sha256": ("string", lambda packed, texts: pa.array(map(_digest, packed), pa.string())),
    "decoded_sha256": ("string", lambda packed, texts: pa.array([_digest(t.encode("utf-8", "surrogatepass")) for t in texts], pa.string())),
}


def encoded(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "token_ids", "decoded"),
) -> DataFrame:
    """One row per document: its id and the *columns* asked for.

    n_tokens; token_ids; decoded (the text decoded from the ids again); ids_sha256 (of the
    ids as little-endian unsigned 32-bit integers); decoded_sha256 (of the decoded text).
    """
    with open(path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    names = ["id", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            for at, texts in text_portions(batch.column(1), CHUNK):
                packed = codec.encode_all(texts)
                decoded = [codec.decode(p) for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *(_COLUMNS[c][1](packed, decoded) for c in columns)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} {_COLUMNS[c][0]}" for c in columns)])).withColumnRenamed("id", id_col)
    )


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op10_trie_bpe": op10_trie_bpe}
ORACLES: dict[str, str] = {}
