"""Token counts of whole texts under a byte-level BPE, without encoding the same pre-token twice.

Tier one is a table of frequent pre-tokens and their lengths in tokens, broadcast to every worker. Tier two is
a cache in each worker process: pre-tokens that miss both are encoded by the library, once per cache lifetime.
Pre-tokens are never shuffled; one pass over the documents, one row out per row in.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import documents, text_chunks, texts

#: In texts of these characters alone, the library's split and SIMPLE agree; other texts are split by the library.
UNUSUAL = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
SIMPLE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")

_workers: dict[str, tuple] = {}


def load(path: str):
    """The tokenizer, this process's cache, and the added tokens' strings."""
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _workers[path] = tokenizer, {}, added
    return _workers[path]


def pre_tokens(tokenizer, text: str) -> list[str]:
    if not UNUSUAL.search(text):
        return SIMPLE.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def lengths(tokenizer, pieces: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def frequent_lengths(docs: DataFrame, path: str, entries: int, sample_rows: int) -> dict[str, int]:
    """The most frequent pre-tokens of a sample of about `sample_rows` documents, at most `entries`, with lengths.

    Only a cache's first filling: counts do not depend on it.
    """
    rows = docs.count()
    fraction = min(1.0, sample_rows / max(rows, 1))

    def count(batches):
        tokenizer, _, _ = load(path)
        for batch in text_chunks(batches):
            seen: Counter = Counter()
            for text in texts(batch):
                seen.update(pre_tokens(tokenizer, text))
            often = [(p, n) for p, n in seen.items() if n > 1 and len(p) < 64]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["piece", "n"])

    sample = docs.select("text") if fraction == 1 else docs.select("text").sample(fraction, seed=1)
    counted = sample.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(entries).collect()]
    return dict(zip(top, lengths(load(path)[0], top)))


def count_tokens(docs: DataFrame, path: str, entries: int = 20_000, sample_rows: int = 4096, cache_entries: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens per row of `docs`, as the tokenizers library counts them.

    No begin, end or other added tokens; an added token's string inside a text counts as the library counts it
    by default. A null text is empty; rows are independent, so repeated rows and null ids are kept as they are.
    `path` is a tokenizer file on every machine, with byte-level pre-tokens and no normaliser (others are refused).
    `entries` bounds the broadcast table, `cache_entries` each worker's cache, which starts anew when full.
    """
    tokenizer = load(path)[0]
    if tokenizer.normalizer is not None or "ByteLevel" not in repr(tokenizer.pre_tokenizer) or "add_prefix_space=True" in repr(tokenizer.pre_tokenizer):
        raise ValueError("pre-tokens are independent only under plain byte-level pre-tokenisation")
    docs = documents(docs)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, entries, sample_rows))

    def count(batches):
        tokenizer, cache, added = load(path)
        frequent = table.value
        for batch in text_chunks(batches):
            whole = texts(batch)
            split = [None if any(a in t for a in added) else pre_tokens(tokenizer, t) for t in whole]
            # Tier one is looked up again below: the sum over a document is then a single pass over two tables.
            missing = {p for pieces in split if pieces for p in pieces if p not in frequent and p not in cache}
            if len(cache) + len(missing) > cache_entries:
                cache.clear()
                missing = {p for pieces in split if pieces for p in pieces if p not in frequent}
            order = list(missing)
            for i in range(0, len(order), 10_000):
                part = order[i : i + 10_000]
                cache.update(zip(part, lengths(tokenizer, part)))
            n = [
                len(tokenizer.encode(t, add_special_tokens=False).ids)
                if pieces is None
                else sum([frequent[p] if p in frequent else cache[p] for p in pieces])
                for t, pieces in zip(whole, split)
            ]
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
