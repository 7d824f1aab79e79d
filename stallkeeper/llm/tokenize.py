"""Token ids of the public byte-level BPE vocabulary, inside Python workers."""

from __future__ import annotations

import base64
import functools
import json
import os

TOKENIZER = "byte_bpe_50k"


class ByteBpe:
    """Ids of the tokenizer file ``<name>.json``, whose special strings stand for their own ids.

    The same vocabulary as ranks (``<name>.tiktoken``) gives the same ids about three times faster; the tokenizer file
    itself handles every text that holds a special string.
    """

    def __init__(self, name: str = TOKENIZER, folder: str | None = None):
        import public_tokenizers
        import tiktoken

        self.file = os.path.join(folder, f"{name}.json") if folder else public_tokenizers.path(f"{name}.json")
        with open(self.file.removesuffix("json") + "tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.file, encoding="utf-8") as file:  # the tokenizer itself, which is large, is built only if a text needs it
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]

    @functools.cached_property
    def whole(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.cache
def byte_bpe(name: str = TOKENIZER, folder: str | None = None) -> ByteBpe:
    """One tokenizer per worker process."""
    return ByteBpe(name, folder)
