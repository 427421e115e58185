"""Ids of a byte-level BPE vocabulary, as the tokenizers library gives them."""

from __future__ import annotations

import base64
import json
import re

import numpy as np

#: Splits text before the merges, as the vocabulary's own file says: a fixed value of that format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these characters the two libraries may follow different versions of Unicode.
_unsettled = re.compile("[^\x00-ɏ]")


class ByteBpe:
    """vocabulary: the bytes of the tokenizers file; ranks: those of the same vocabulary as ranks.

    The rank form is several times faster and gives the same ids; texts with the vocabulary's special strings or with
    characters whose classes changed between versions of Unicode take the tokenizers library itself.
    """

    def __init__(self, vocabulary: bytes, ranks: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode())
        self.special = [x["content"] for x in json.loads(vocabulary).get("added_tokens", [])]
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _unsettled.search(text) or any(x in text for x in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
