"""Token ids of whole texts, with the `tokenizers` file as authority.

A byte-level BPE file is run by a compiled BPE built from that file's own
vocabulary, several times faster than the
library and with the same ids, provided that the ids of its merges ascend; texts with special strings, and anything out of
the ordinary, go to the library. Other kinds of file go to their library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Fixed value: the split pattern of byte-level BPE files that name no pattern of their own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space of this length, of any kinds, go to the library: the compiled pattern backtracks on them.
RUN = 200
_run = re.compile(rf"\s{{{RUN}}}")
#: Every 25th character: such a run holds 8 in a row.
_STEP = 25
_maybe = re.compile(rf"\s{{{RUN // _STEP}}}")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def long_run(text: str) -> bool:
    """Whether the text has a run of white space that goes to the library."""
    return bool(_maybe.search(text[::_STEP]) and _run.search(text))


def ids_ascend(model: dict, special: set[str]) -> bool:
    """Whether the ids of a BPE file rank its merges, and nothing but merges and letters has one."""
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in pairs]
    whole = {a + b for a, b in pairs}
    return None not in ids and all(x < y for x, y in zip(ids, ids[1:])) and all(len(t) == 1 or t in whole or t in special for t in model["vocab"])


class Encoder:
    """ids(text): an array of unsigned 32-bit ids, without begin, end or added
    special tokens; special strings in a text as the library's default has
    them; nothing cut or padded."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            self.whole = sentencepiece.SentencePieceProcessor(model_file=path).encode
            self.ids = self._by_library
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.whole = lambda text: library.encode(text, add_special_tokens=False).ids
        self.ids = self._by_library
        kind = json.loads(library.to_str())
        pre, model, added = kind["pre_tokenizer"] or {}, kind["model"], kind["added_tokens"]
        if (
            model["type"] != "BPE" or kind["normalizer"] or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges")
            or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or not ids_ascend(model, {t["content"] for t in added})
        ):
            return
        import tiktoken

        letters, special = _byte_letters(), [t["content"] for t in added]
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.ids = self._compiled

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.whole(text), np.uint32)

    def _compiled(self, text: str) -> np.ndarray:
        if self.special.search(text) or long_run(text):
            return self._by_library(text)
        return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def count(self, text: str) -> int:
        return len(self.ids(text)) if text else 0


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def file_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
