"""Token ids of whole texts with a public byte-level BPE vocabulary.

The vocabulary file is the ``tokenizers`` JSON; its path is a parameter and is
opened where the text is, once per worker process. Encoding runs on the merge
ranks of that file (for byte-level BPE a token's rank is its id), which gives
the ids of ``tokenizers`` at several times its speed; a test holds the two
against each other.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

VOCABULARY = "byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable letter; letter -> byte.

    Printable bytes stand for themselves; the others take the letters from
    U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY):
    """A function from text to a list of ids; special-token strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): id_ for token, id_ in data["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        try:
            return fast(text)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException as error:  # its pattern engine gives up on very long white space, as a panic, which is no Exception
            if type(error).__module__ != "pyo3_runtime":
                raise
        return _reference_encoder(path)(text)

    return encode


@functools.lru_cache(maxsize=4)
def _reference_encoder(path: str):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def lengths(vocabulary: str):
    """mapInArrow function: (text) batches to (n_tokens) batches; null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            n = np.fromiter((len(encode(t)) if t else 0 for t in (s.as_py() for s in batch.column(0))), "int64", batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(n)], ["n_tokens"])

    return run
