"""SentencePiece encoding and decoding by a forward pass that common prefixes share.

A text is cut into marked words (a run of `▁`, then other characters); no piece crosses such a cut. The distinct
words of a chunk that the worker has not met are sorted, which lays them out as a trie in depth-first order: going
from one word to the next, the forward scores of their common prefix stay and only the rest is computed.

For a unigram model the forward score of a prefix is the best sum of piece scores (Viterbi). A BPE model ranks
merges rather than sums scores, and the best sum is another segmentation than the library's; there the forward
state of a prefix is the last piece of its BPE encoding, the one piece that ends there and is compatible with the
last piece of what stands before it. Two neighbours are compatible if their concatenation encodes to just them.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import documents, release, text_chunks, texts

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

#: What is kept from chunk to chunk: pairs of pieces that were tested, and encoded words.
KEPT_PAIRS = 150_000
KEPT_WORDS = 60_000

_workers: dict[str, tuple] = {}


class Model:
    """Pieces of a model file, and the encoding of sorted words with them."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.get_piece_size()
        pieces = [processor.id_to_piece(i) for i in range(size)]
        self.bytes = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = processor.unk_id()
        self.fallback = all(processor.is_byte(i) for i in self.bytes)
        self.ids = {
            p: i
            for i, p in enumerate(pieces)
            if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unused(i) or processor.is_unknown(i))
        }
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of this model crosses word boundaries")
        self.scores = {p: processor.get_score(i) for p, i in self.ids.items()}
        # A unigram model's scores are log probabilities, a BPE model's are the negative ranks of merges.
        self.bpe = all(s == int(s) for s in self.scores.values())
        self.compatible: dict[tuple[str, str], bool] = {}
        if self.bpe:
            self.halves = {p: self.last_merge(p) for p in self.ids if len(p) > 1}
            # Pieces that their own merges don't make never stand in an encoding.
            self.usable = {p for p in self.ids if len(p) == 1 or self.halves[p]}
            # Single characters are there before any merge.
            self.rank = {p: -self.scores[p] if len(p) > 1 else -1.0 for p in self.usable}
        else:
            self.usable = set(self.ids)
            self.least = min(self.scores.values()) - 10
        self.grow_automaton()
        self.texts = [
            bytes([self.bytes.index(i)]) if processor.is_byte(i) else b"" if processor.is_control(i) else b" \xe2\x81\x87 " if processor.is_unknown(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes `piece` when BPE runs on it: the best pair, leftmost first, again and again."""
        parts = list(piece)
        while True:
            at = [(-self.scores[s], i) for i in range(len(parts) - 1) if (s := parts[i] + parts[i + 1]) in self.scores]
            if not at:
                return None
            i = min(at)[1]
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether the two stay apart when BPE runs on their concatenation.

        Their merges are taken back one by one, the latest first. If at any time what then touches at the border
        would have merged before the merge just taken back, the border would not have lasted.
        """
        rank = self.rank
        before = float("inf")  # only a merge ranked below this could have come first
        while True:
            joined = left + right
            if joined in self.scores and -self.scores[joined] < before:
                return False
            a, b = rank.get(left, -1.0), rank.get(right, -1.0)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.halves[left][1]
            else:  # of two equal merges the border's comes before one on its right
                before, right = b + 0.5, self.halves[right][0]

    def grow_automaton(self) -> None:
        """An Aho-Corasick automaton of the usable pieces: a state per prefix, with the pieces that end there, longest first."""
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, ...]] = [()]
        for p in self.usable:
            state = 0
            for c in p:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                state = self.next[state][c]
            self.ends[state] = (p,)
        self.back = [0] * len(self.next)
        level = list(self.next[0].values())
        while level:
            below = []
            for state in level:
                for c, child in list(self.next[state].items()):
                    back = self.back[state]
                    while back and c not in self.next[back]:
                        back = self.back[back]
                    self.back[child] = self.next[back].get(c, 0)
                    self.ends[child] += self.ends[self.back[child]]
                    below.append(child)
            level = below

    def step(self, state: int, c: str) -> int:
        """The next state; transitions that fall back are kept once they were needed."""
        back = state
        while back and c not in self.next[back]:
            back = self.back[back]
        to = self.next[back].get(c, 0)
        if back != state and to:
            self.next[state][c] = to
        return to

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian int32; `words` are sorted and distinct."""
        bpe, ends, step, after = self.bpe, self.ends, self.step, self.next
        compatible, scores = self.compatible, self.scores
        if len(compatible) > KEPT_PAIRS:
            compatible.clear()
        states, last, best = [0], [""], [0.0]  # of each prefix of the word at hand
        previous, out = "", []
        for word in words:
            shared, most = 0, min(len(previous), len(word))
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], best[shared + 1 :]
            state = states[-1]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                state = after[state].get(c) or step(state, c)
                states.append(state)
                chosen = c
                if bpe:
                    for piece in ends[state]:
                        start = end - len(piece)
                        if not start:
                            chosen = piece
                            break
                        pair = (last[start], piece)
                        fit = compatible.get(pair)
                        if fit is None:
                            fit = compatible[pair] = self.fits(*pair)
                        if fit:
                            chosen = piece
                            break
                else:
                    top = best[end - 1] + (scores[c] if c in scores else self.least)
                    for piece in ends[state]:
                        s = best[end - len(piece)] + scores[piece]
                        if s > top:
                            top, chosen = s, piece
                    best.append(top)
                last.append(chosen)
            previous = word
            out.append(self.path_ids(last, len(word)))
        return out

    def path_ids(self, last: list[str], end: int) -> bytes:
        path = []
        while end:
            path.append(last[end])
            end -= len(last[end])
        ids: list[int] = []
        for piece in reversed(path):
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.fallback:
                ids += [self.bytes[b] for b in piece.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}i", *ids)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> tuple[Model, dict[str, bytes]]:
    if path not in _workers:
        _workers[path] = Model(path), {}
    return _workers[path]


def marked_words(text: str) -> list[str]:
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def encoded_chunks(batches: Iterator[pa.RecordBatch], path: str, cache_words: int = KEPT_WORDS):
    """Chunks of the batches, each with its texts' packed ids.

    A task keeps the encodings of at most `cache_words` words besides one chunk's; the model goes when it ends.
    """
    model, cache = load(path)
    for batch in text_chunks(batches, limit=2 << 20):
        words = [marked_words(t) for t in texts(batch)]
        new = {w for ws in words for w in ws if w not in cache}
        if len(cache) + len(new) > cache_words:
            cache.clear()
            new = {w for ws in words for w in ws}
        order = sorted(new)
        cache.update(zip(order, model.encode_sorted(order)))
        yield batch, [b"".join([cache[w] for w in ws]) for ws in words]
    _workers.pop(path, None)
    cache.clear()
    del model
    release()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, ids (little-endian int32, packed) per row of `docs`.

    `path` is a SentencePiece model on every machine, without begin and end marks, its normaliser the identity
    with a dummy prefix, as the library encodes with it. Null and empty texts have no ids; repeated rows and null
    ids are kept; other columns are not read. Nothing is shuffled.
    """

    def encode(batches):
        for batch, ids in encoded_chunks(batches, path):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    return documents(docs).mapInArrow(encode, "doc_id long, text string, ids binary")


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows of `encoded` with a column `decoded`, the text that the packed ids spell."""

    def decode(batches):
        model, _ = load(path)
        for batch in batches:
            back = [None if b is None else model.decode(np.frombuffer(b, "<i4")) for b in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(decode, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, round_trip: the encoding's length and digest, and whether it decodes to the text.

    It is false for a text that holds `▁`, which decoding gives back as a space. Encoding and decoding share a worker, so
    that the model is held once per task.
    """

    def check(batches):
        model, _ = load(path)
        for batch, packed in encoded_chunks(batches, path):
            same = [model.decode(np.frombuffer(b, "<i4")) == t for b, t in zip(packed, texts(batch))]
            columns = [
                batch.column("doc_id"),
                pa.array([len(b) // 4 for b in packed], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in packed]),
                pa.array(same),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    return documents(docs).mapInArrow(check, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")


def piece_arrays(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, pieces (array of int) per row of `docs`."""

    def encode(batches):
        for batch, packed in encoded_chunks(batches, path):
            cuts = np.concatenate(([0], np.cumsum([len(b) // 4 for b in packed])))
            flat = np.frombuffer(b"".join(packed), "<i4")
            pieces = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pieces], ["doc_id", "pieces"])

    return documents(docs).mapInArrow(encode, "doc_id long, pieces array<int>")
