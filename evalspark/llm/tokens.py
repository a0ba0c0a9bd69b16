"""The tokenizer of a vocabulary file, as tasks use it."""

from __future__ import annotations

import functools
import json

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str | None = None) -> str:
    """Place of a vocabulary file: a path as it is, a bare name among the installed public tokenizers."""
    name = name or VOCABULARY
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others follow from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class FastTokenizer:
    """Ids of a byte-level vocabulary in the JSON format, special strings included.

    The ids are those of the ``tokenizers`` library; the merges run in ``tiktoken``, which
    takes a quarter of the time for the same vocabulary. A text that it refuses, such as
    one with very long runs of white space, goes to ``tokenizers``.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in stated["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in stated["model"]["vocab"].items() if token not in added}
        self.path, self.special = path, set(added)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.slow = None
        self.sizes = np.zeros(1 + max([*ranks.values(), *added.values()]), dtype=np.int64)  # bytes of each token
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.sizes[i] = len(token)

    def within(self, ids: np.ndarray, size: int) -> int:
        """How many leading tokens end within the first ``size`` bytes."""
        return int(np.searchsorted(np.cumsum(self.sizes[ids[: size + 1]]), size, side="right")) if size > 0 else 0

    def encode_array(self, text: str) -> np.ndarray:
        try:
            if not any(x in text for x in self.special):
                return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
            return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype(np.uint32, copy=False)
        except BaseException as e:  # a panic of the pattern matcher is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=4)
def tokenizer(name: str | None = None) -> FastTokenizer:
    return FastTokenizer(vocabulary_path(name))
