"""The public byte-level BPE vocabulary, loaded once in each Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZER_DIR = os.environ.get("TOUCHLINE_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the published pre-token pattern of the vocabulary, as the
#: encoder library reads it, and the same pattern for Java, where white space
#: and letters are Unicode classes only when named so.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
JAVA_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"""
    r"""|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"""
)


@lru_cache(maxsize=4)
def ranks(folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """Piece to id, from the rank file of the vocabulary."""
    out: dict[bytes, int] = {}
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        for line in lines:
            parts = line.split()
            if len(parts) == 2:
                out[base64.b64decode(parts[0])] = int(parts[1])
    return out


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k"):
    """The encoder; no special tokens, their strings are ordinary text."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(folder, name), special_tokens={})
