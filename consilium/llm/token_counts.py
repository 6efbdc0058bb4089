"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
#: UTF-8 bytes that one encoding call gets at most, and the length from which a text is split.
BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 16

# A pre-token never holds a blank after a non-blank, so a cut between the two moves no token.  Only blanks
# that every library counts as such are cut at; \S excludes all that any of them does.
_SAFE = re.compile(r"(?<=\S)(?=[\x20\x09-\x0D])")


class Encoder:
    """Byte-level BPE over the ranks of ``byte_bpe_50k``.

    ``fast=True`` runs the same vocabulary through its rank file, whose ids are
    those of the JSON file (``tests/llm`` holds both against each other);
    ``fast=False`` calls the JSON file's own library.  ``ids`` takes a batch in
    one call: a special token stands between its texts, and parts them again
    by its id.  Texts that hold it themselves go by themselves.
    """

    def __init__(self, vocabulary: str = VOCABULARY, fast: bool = True):
        import public_tokenizers

        if fast:
            import tiktoken

            with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            enc = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
            self._whole = lambda text: enc.encode_to_numpy(text, allowed_special=enc.special_tokens_set, disallowed_special=())
            self.ids = self._joined
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
            self.ids = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]

    def _joined(self, texts: list[str]) -> list[np.ndarray]:
        between, mark = next(iter(SPECIAL.items()))
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if between not in t]
        if plain:
            every = self._whole(between.join(texts[i] for i in plain))
            at = np.flatnonzero(every == mark)
            for i, start, end in zip(plain, [0, *(at + 1)], [*at, len(every)], strict=True):
                out[i] = every[start:end]
        return [self._whole(t) if x is None else x for t, x in zip(texts, out, strict=True)]


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a long text at safe boundaries, each about ``size`` characters or longer where no blank offers one."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut or cut.start() >= len(text):
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def batches(texts: Iterable[str | None], batch_bytes: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """(owners, pieces): the texts' pieces (null: one empty) in order, in batches of about equal UTF-8 bytes."""
    owners: list[int] = []
    batch: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        for piece in pieces(text or ""):
            batch.append(piece)
            owners.append(i)
            held += len(piece.encode("utf-8", "surrogatepass"))
            if held >= batch_bytes:
                yield owners, batch
                owners, batch, held = [], [], 0
    if batch:
        yield owners, batch


def count_tokens(texts: list[str | None], encoder: Encoder, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Token counts of ``texts`` (null: empty), encoded in batches of about equal bytes."""
    counts = [0] * len(texts)
    for owners, batch in batches(texts, batch_bytes):
        for owner, ids in zip(owners, encoder.ids(batch), strict=True):
            counts[owner] += len(ids)
    return counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def cached_encoder(vocabulary: str = VOCABULARY, fast: bool = True) -> Encoder:
    """One encoder a Python worker, not one a batch."""
    key = (vocabulary, fast)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, fast)
    return _encoders[key]


def token_count(text: Column, vocabulary: str = VOCABULARY, fast: bool = True) -> Column:
    """A column of token counts; only lengths leave the Python worker."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = cached_encoder(vocabulary, fast)
        for texts in batches:
            yield pa.array(count_tokens(texts.to_pylist(), encoder), pa.int64())

    return lengths(text)


def with_token_counts(docs: DataFrame, limit: int = 512) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text counts 0 bytes and 0 tokens.  Null ids and repeated
    rows pass through row by row; other columns, whatever their names, are not
    read.  An empty table gives an empty result.
    """
    own = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    counted = own.select("doc_id", F.octet_length("t").cast("long").alias("n_bytes"), token_count(F.col("t")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_token_counts(load(spark, sf_dir, "documents"))
