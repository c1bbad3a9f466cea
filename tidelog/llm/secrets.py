"""Secrets in texts: three fixed patterns, and random-looking tokens found by a pair of character Markov models.

One model is of random strings, the other of ordinary identifiers; a token whose log-likelihood ratio is high
enough is taken for a secret. Both are trained from labelled samples: what the patterns find and strings drawn
at random on one side, words and identifiers of the documents on the other.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import documents, text_chunks, texts

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
#: Labelled ordinary when training: letters, in parts, with a short number at the end.
ORDINARY = re.compile("[A-Za-z]+(?:[_-][A-Za-z]+)*[0-9]{0,4}")
MARKS = "+/_=-"
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Code of each character below 128; row and column EDGE of a model, a line break here, stand for the token's edge.
EDGE = len(ALPHABET)
CODE = np.zeros(128, np.int64)
CODE[[ord(c) for c in ALPHABET + "\n"]] = np.arange(EDGE + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; leftmost and non-overlapping per kind, in code points."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def codes(tokens: list[str]) -> np.ndarray:
    return CODE[np.frombuffer("\n".join(["", *tokens, ""]).encode("ascii"), np.uint8)]


def free_tokens(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of long tokens, and of the long stretches that the spans of `taken`, sorted, leave of those they touch.

    The marks that part a stretch from a span are no part of it.
    """
    out = []
    for m in TOKEN.finditer(text):
        at = m.start()
        for a, _, b in taken:
            if a < m.end() and at < b:
                end = at + len(text[at:a].rstrip(MARKS))
                if at > m.start():
                    at = end - len(text[at:end].lstrip(MARKS))
                out.append((at, end))
                at = b
        if at > m.start():
            at = m.end() - len(text[at : m.end()].lstrip(MARKS))
        out.append((at, m.end()))
    return [(a, b) for a, b in out if b - a >= 16]


def pair_counts(tokens: list[str]) -> np.ndarray:
    """How often each character follows each other one."""
    c = codes(tokens)
    return np.bincount(c[:-1] * (EDGE + 1) + c[1:], minlength=(EDGE + 1) ** 2).reshape(EDGE + 1, EDGE + 1) * float(len(tokens) > 0)


def ordinary_tokens(text: str) -> list[str]:
    """Longer words and identifiers of a text; also in capitals, as their case doesn't make them random."""
    words = {w for w in text.replace(",", " ").replace(".", " ").split() if len(w) >= 8 and ORDINARY.fullmatch(w)}
    return [v for w in words for v in (w, w.upper(), w.capitalize())]


def drawn_at_random(n: int, seed: int = 7) -> list[str]:
    draw = random.Random(seed)
    kinds = [ALPHABET[:64], ALPHABET[:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], "0123456789abcdef"]
    return ["".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(16, 44))) for i in range(n)]


def probabilities(counts: np.ndarray, trust: float = 8.0) -> np.ndarray:
    """P(next | this); a rarely seen character's successors are drawn towards how often each character comes at all."""
    single = counts.sum(0) + 0.5
    return (counts + trust * single / single.sum()) / (counts.sum(1, keepdims=True) + trust)


def log_ratio(random_counts: np.ndarray, ordinary_counts: np.ndarray) -> np.ndarray:
    """log P(next | this) under random strings less the same under ordinary identifiers."""
    return np.log(probabilities(random_counts)) - np.log(probabilities(ordinary_counts))


def score(token: str, ratio: np.ndarray) -> float:
    c = codes([token])
    return float(ratio[c[:-1], c[1:]].sum())


def train(docs: DataFrame, sample_rows: int, drawn: int) -> np.ndarray:
    """The models' log ratio, from about `sample_rows` documents and `drawn` random strings.

    The counts of both models are summed by Spark: one row per pair of characters, however many documents.
    """
    fraction = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select("text") if fraction == 1 else docs.select("text").sample(fraction, seed=3)

    def count(batches):
        for batch in text_chunks(batches):
            secret, plain = [], []
            for text in texts(batch):
                base = base_spans(text)
                secret += [text[a:b] for a, k, b in base if k]
                plain += ordinary_tokens(text)
            for label, tokens in ((1, secret), (0, plain)):
                at = np.nonzero(pairs := pair_counts(tokens))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at[0]), label, np.int32)), pa.array(at[0] * (EDGE + 1) + at[1]), pa.array(pairs[at].astype(np.int64))],
                    ["label", "pair", "n"],
                )

    sums = sample.mapInArrow(count, "label int, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = [np.zeros((EDGE + 1) ** 2), pair_counts(drawn_at_random(drawn)).ravel()]
    for r in sums:
        counts[r["label"]][r["pair"]] += r["n"]
    return log_ratio(counts[1].reshape(EDGE + 1, -1), counts[0].reshape(EDGE + 1, -1))


def markov_spans(text: str, base: list[tuple[int, int, int]], ratio: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    return [(a, 3, b) for a, b in free_tokens(text, base) if score(text[a:b], ratio) >= least]


def scan_secrets(docs: DataFrame, sample_rows: int = 20_000, drawn: int = 4000, least: float = 4 * math.log(10)) -> DataFrame:
    """doc_id, text, base, added per row of `docs`; both are arrays of (kind, start, end) in code points.

    `added` are tokens of 16 characters and more, or what base spans leave of them if that is as long, that are at least exp(`least`) times
    as likely under the model of random strings (10,000 times by default). A null text is empty and has no spans;
    repeated rows and null ids are kept as they are. The models are fitted to about `sample_rows` documents.
    """
    docs = documents(docs)
    ratio = train(docs, sample_rows, drawn)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches):
        for batch in text_chunks(batches):
            base = [base_spans(t) for t in texts(batch)]
            added = [markov_spans(t, b, ratio, least) for t, b in zip(texts(batch), base)]
            structs = [pa.array([[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in s] for s in spans], kind) for spans in (base, added)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *structs], ["doc_id", "text", "base", "added"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.mapInArrow(scan, f"doc_id long, text string, base {spans}, added {spans}")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and spans as text, from `scan_secrets`."""

    def joined(spans):
        rank = F.array_position(F.array(*map(F.lit, KINDS)), spans["kind"])
        return F.concat_ws(":", spans["kind"], spans["start"], spans["end"]), F.struct(spans["start"], rank, spans["end"])

    def text_of(c):
        keyed = F.array_sort(F.transform(c, lambda s: F.struct(joined(s)[1].alias("k"), joined(s)[0].alias("t"))))
        return F.array_join(F.transform(keyed, lambda s: s["t"]), ",")

    def number(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    return found.select(
        "doc_id",
        *[number(k) for k in KINDS[:3]],
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        text_of(F.concat("base", "added")).alias("spans"),
    )


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """`text` with every stretch that spans cover replaced by one mark."""
    out, at, covered = [], 0, -1
    for a, b in sorted(spans):
        if a >= covered:
            out += [text[at:a], mark]
        at = covered = max(covered, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, **options) -> DataFrame:
    """The columns and rows of `docs`, secrets in `text` replaced by a mark and `n_chars`, if there, as it is then.

    Other columns stay; a null text stays null.
    """
    kinds = dict(docs.dtypes)
    ratio = train(documents(docs), options.get("sample_rows", 20_000), options.get("drawn", 4000))
    least = options.get("least", 4 * math.log(10))
    at = docs.columns.index("text")

    def rewrite(batches):
        for batch in text_chunks(batches):
            new = []
            for t in batch.column("text").to_pylist():
                base = base_spans(t or "")
                spans = [(a, b) for a, _, b in base + markov_spans(t or "", base, ratio, least)]
                new.append(redact(t, spans) if spans else t)
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
