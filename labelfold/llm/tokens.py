"""Public tokenizers inside tasks: loaded once per Python worker, fed by runs of bounded size.

A tokenizer is named by the path of its vocabulary file, which every machine must have.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes that one call of a tokenizer takes; a longer text is a call of its own.
RUN_BYTES = 1 << 20


def public_path(name: str) -> str:
    """Where the installed public vocabularies keep a file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_level(path: str, plain: bool):
    """A byte-level BPE of the ``tokenizers`` library; ``plain`` reads the strings of special tokens as text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain
    return found


#: The pattern that byte-level pre-tokenizers split by (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer runs of white space or of other characters go to ``tokenizers``, which is linear in them.
LONG_RUN = re.compile(r"\s{2000}|\S{2000}")


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """Bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    # the byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    letter = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    words = vocabulary["model"]["vocab"]
    added = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
    out = [b""] * (max([*words.values(), *added.values()]) + 1)
    for word, i in words.items():
        out[i] = bytes(letter[c] for c in word) if word not in added else word.encode()
    for word, i in added.items():
        out[i] = word.encode()
    return tuple(out)


@lru_cache(maxsize=4)
def _ranked(path: str):
    """The same vocabulary for ``tiktoken``, if its merges stand in the order of their ids and its pattern is the known one."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    merges = [m if isinstance(m, list) else m.split(" ") for m in vocabulary["model"]["merges"]]
    words, split = vocabulary["model"]["vocab"], vocabulary["pre_tokenizer"]
    plain_added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in vocabulary["added_tokens"])
    if (vocabulary["normalizer"] is not None or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]
            or not plain_added or any(words["".join(m)] != 256 + i for i, m in enumerate(merges))):
        return None
    import tiktoken
    special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
    ranks = {b: i for i, b in enumerate(token_bytes(path)) if i not in special.values()}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class ByteIds:
    """Ids of a byte-level BPE as ``tokenizers`` gives them, without special tokens added.

    ``tiktoken`` computes the same ids from the same vocabulary several times as fast (tests compare
    both); texts with very long runs go to ``tokenizers`` itself.  ``plain`` reads the strings of
    special tokens as text.
    """

    def __init__(self, path: str, plain: bool):
        self.path, self.plain, self.fast = path, plain, _ranked(path)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        slow = [i for i, t in enumerate(texts) if self.fast is None or LONG_RUN.search(t)]
        allowed = frozenset() if self.plain else self.fast and self.fast.special_tokens_set
        out: list = [None] * len(texts)
        if slow:
            found = byte_level(self.path, self.plain).encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)
            for i, e in zip(slow, found):
                out[i] = np.array(e.ids, np.int32)
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.fast.encode_to_numpy(t, allowed_special=allowed, disallowed_special=()).view(np.int32)
        return out


@lru_cache(maxsize=4)
def pieces(path: str):
    """A SentencePiece model."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def text_runs(batch: pa.RecordBatch, column: str = "text", limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text, a single longer text aside."""
    texts = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop

