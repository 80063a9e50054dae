"""Token ids of whole texts by a byte-level pair vocabulary."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: Fixed value: how byte-level vocabularies of this family cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of so many characters is cut off by its own rule; the library fails at about a million.
LONG_RUN = 65_536
_SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such a vocabulary's file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Encoder for a tokenizer file (.json) of the byte-level kind.

    Its ids are those of the file's own library, special strings in texts included; the
    merging is done from the same vocabulary by a library about four times as fast.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"{path} cuts texts in another way")
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ranks = {
            bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        self.size = max(*ranks.values(), *special.values()) + 1

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, one after another."""
        parts, at = [], 0
        if len(text) >= LONG_RUN:
            for run in re.finditer(f"{_SPACES}{{{LONG_RUN},}}", text):
                end = run.end()
                if end < len(text) and not text.startswith(self.special, end):
                    end -= 1  # the pattern leaves the last one to what follows
                parts.append(self._short_runs(text[at : run.start()]))
                parts.append(np.array(self.encoding._encode_single_piece(text[run.start() : end]), "<u4"))
                at = end
        parts.append(self._short_runs(text[at:] if at else text))
        return b"".join(part.tobytes() for part in parts)

    def _short_runs(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
