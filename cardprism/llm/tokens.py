"""Token ids of the public byte-level BPE vocabulary.

``tokenizers`` defines the ids.  Texts of ASCII and Latin letters, where both
libraries read the pre-tokenizer's character classes alike, go through
``tiktoken`` with the same vocabulary as ranks (five times as fast, same ids);
all other texts, and those with very long unbroken runs, through
``tokenizers``."""

from __future__ import annotations

import base64
import os
import re

from cardprism.llm.common import tokenizer_path

_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_LONG = re.compile(r"\S{2000}|\s{2000}")


class ByteBpe:
    def __init__(self, folder: str | None = None, name: str = "byte_bpe_50k"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(tokenizer_path(f"{name}.json", folder))
        self.exact.encode_special_tokens = True
        self.quick = self._ranks(tokenizer_path(f"{name}.tiktoken", folder))

    @staticmethod
    def _ranks(path: str):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _OTHER.search(text) or (len(text) > 2000 and _LONG.search(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)
