"""Byte-level BPE of whole texts by the rules of a tokenizers JSON file.

tokenizers encodes every text that is not plain. Plain texts (ASCII and Latin
letters, no added token's string) go through tiktoken, loaded with the JSON's
own vocabulary and pattern, which is three times as fast. The two give the same
ids if every token's bytes, encoded alone by the JSON's merges, give that very
token: then the only two tokens that can meet as its halves are those of its
merge, so merging by the rank of the result is merging by the list. That is
tested for the whole vocabulary when a worker loads it; if it failed, or for
another kind of tokenizer, everything would go through tokenizers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern by which byte-level BPE cuts a text (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose classes all Unicode versions and libraries agree are the rest.
BEYOND = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
#: No piece of the pattern crosses these places: a single space or line end between signs that are
#: none (each kind of piece may begin with the space), and a letter before such a mark.
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=[^\W\d_])(?=[。、，！？；：])")


def safe_parts(text: str, size: int) -> list[str]:
    """Cuts a long text, at least size characters a part, where no piece of the pattern crosses.

    So the parts' ids add up to the text's. There are such places in texts of
    every script that has spaces, lines or marks; a text without any stays whole.
    """
    parts, start = [], 0
    while len(text) - start > size:
        found = CUT.search(text, start + size)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    parts.append(text[start:])
    return parts


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts, without begin, end, truncation or padding."""

    def __init__(self, path: str, part_chars: int = 65_536):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.bpe = Tokenizer.from_file(path)
        self.bpe.no_truncation()
        self.bpe.no_padding()
        self.dtype = np.dtype("<u2" if self.bpe.get_vocab_size() <= 65_536 else "<u4")
        self.part_chars = part_chars
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        """tiktoken with the same vocabulary, or None where it may differ."""
        import tiktoken
        from tokenizers import Tokenizer, models

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            return None
        tokens = {k: v for k, v in model["vocab"].items() if k not in self.added}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ranks = [tokens.get(a + b, -1) for a, b in merges]
        if any(x >= y for x, y in zip(ranks, ranks[1:])):
            return None
        lone, names = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges)), list(tokens)
        for k in range(0, len(names), 1000):  # not all at once, for the worker's memory
            part = names[k : k + 1000]
            if any(e.ids != [tokens[name]] for e, name in zip(lone.encode_batch_fast(part), part)):
                return None
        byte = _byte_of()
        return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in k): v for k, v in tokens.items()}, special_tokens={})

    def batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; None counts as the empty text. Long texts go in parts cut at safe places."""
        out: list[list[int]] = [[]] * len(texts)
        plain: list[tuple[int, list[str]]] = []
        rest: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(a in text for a in self.added):  # such a string may take signs beside it along, so the text stays whole
                rest.append((k, [text]))
            else:
                (rest if self.fast is None or BEYOND.search(text) else plain).append((k, safe_parts(text, self.part_chars)))
        if plain:
            codes = iter(self.fast.encode_ordinary_batch([p for _, parts in plain for p in parts], num_threads=1))
            for k, parts in plain:
                out[k] = next(codes) if len(parts) == 1 else [i for _ in parts for i in next(codes)]
        if rest:
            codes = iter(self.bpe.encode_batch_fast([p for _, parts in rest for p in parts], add_special_tokens=False))
            for k, parts in rest:
                out[k] = [i for _ in parts for i in next(codes).ids]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


def by_bytes(column: pa.Array, budget: int) -> Iterator[tuple[int, int, list[int]]]:
    """Slices (start, end, bytes of each) of a string column, of about budget bytes; one long text may be a slice by itself."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > budget:
            yield start, k, sizes[start:k]
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes), sizes[start:]
